import itertools
import random

from tessera.llm import chat
from tessera.llm.chat import INSERT, MERGE, RELABEL, ROLES, format_chats


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and len(roles) % 2 == 0


def brute(roles):
    """Least cost over all labels, merges and numbers of inserted turns."""
    best = 10**9
    for labels in itertools.product(ROLES, repeat=len(roles)):
        relabelled = sum(a != b for a, b in zip(labels, roles, strict=True))
        for merges in itertools.product((False, True), repeat=len(roles)):
            if merges[:1] == (True,) or any(m and labels[k] != labels[k - 1] for k, m in enumerate(merges)):
                continue
            kept = [r for r, m in zip(labels, merges, strict=True) if not m]
            out, inserted, ok = [], 0, True
            for r in [*kept, None]:
                if r == "system":
                    ok &= not out
                    out.append(r)
                    continue
                due = "assistant" if out[-1:] == ["user"] else "user"
                if r is None:
                    fill = 1 if due == "assistant" else 2 if out == ["system"] else 0
                    inserted += fill
                else:
                    inserted += r != due
                    out += [r] if r == due else [due, r]
            if ok:
                best = min(best, RELABEL * relabelled + MERGE * sum(merges) + INSERT * inserted)
    return best


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    kinds = [*ROLES, "user", "assistant", None, "tool"]
    chats = {c: [rng.choice(kinds) for _ in range(rng.randint(1, 5))] for c in range(120)}
    rows = [(c, t, r, None if rng.random() < 0.1 else f"t{t}", 1) for c, roles in chats.items() for t, r in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    whole = {r["conv"]: r for r in format_chats(frame).collect()}
    for c, roles in chats.items():
        r = whole[c]
        made = [t["role"] for t in r["turns"]]
        assert legal(made) and r["cost"] == brute(roles), roles
        assert r["cost"] == MERGE * r["n_merged"] + RELABEL * r["n_relabelled"] + INSERT * r["n_inserted"]
        assert r["rendered"] == "".join(f"<|{t['role']}|>\n{t['text']}<|end|>\n" for t in r["turns"])
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    parts: dict = {}
    for r in sorted(format_chats(frame).collect(), key=lambda r: (r["conv"], r["block"])):
        parts.setdefault(r["conv"], []).append(r)
    for c, blocks in parts.items():
        assert blocks[0]["cost"] == whole[c]["cost"]
        text = "".join(b["rendered"] for b in blocks)
        assert text.count("<|end|>") == text.count("|>\n") // 2
        assert sum(MERGE * b["n_merged"] + RELABEL * b["n_relabelled"] + INSERT * b["n_inserted"] for b in blocks) == whole[c]["cost"]
    assert format_chats(frame.limit(0)).count() == 0


def joined(rows):
    """The conversation that rows of turns make, in their order."""
    out = []
    for r in sorted(rows, key=lambda r: (r["block"], r["place"])):
        if r["continues"]:
            out[-1][1] += "\n" + r["text"]
        else:
            out.append([r["role"], r["text"]])
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in out)


def test_turns_are_rows_whatever_the_length(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice([*ROLES, "user", "user", "tool", None]), f"t{t}" * rng.randint(0, 3)) for c, n in ((1, 900), (2, 3), (3, 300)) for t in range(n)]
    rows += [(None, 1, "user", "no conversation"), (None, 1, "user", "no conversation"), (4, 1, "user", "tied"), (4, 1, "assistant", "tied"), (4, None, "system", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    chats = format_chats(frame)
    turns: dict = {}
    for r in chat.repaired_turns(chats).collect():
        turns.setdefault(r["conv"], []).append(r)
    texts: dict = {}
    for r in sorted(chats.collect(), key=lambda r: (r["conv"] is None, r["conv"] or 0, r["block"])):
        texts[r["conv"]] = texts.get(r["conv"], "") + r["rendered"]
    assert turns.keys() == texts.keys() == {1, 2, 3, 4, None}
    for c, own in turns.items():
        assert joined(own) == texts[c]
        whole = [r["role"] for r in sorted(own, key=lambda r: (r["block"], r["place"])) if not r["continues"]]
        assert legal(whole) and len({r["cost"] for r in own}) == 1
    assert len(turns[1]) > 256 and texts[4].startswith("<|system|>\n" + "x" * 300_000)
