import hashlib
import random

from tessera.llm.repeats import remove_repeats
from tessera.llm.suffix_groups import suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(5)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def words_case(spark, texts, length, words):
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, key string, n int")
    every = {r["id"]: r["spans"] for r in remove_repeats(rows, length=length).collect()}
    some = {r["id"]: (r["spans"], r["n_spans"]) for r in remove_repeats(rows, length=length, least_words=words).collect()}
    for k, t in enumerate(texts):
        spans = every[k]
        want = [x for a, b in zip(spans[::2], spans[1::2], strict=True) if len((t or "").encode()[a:b].split()) >= words for x in (a, b)]
        assert some[k] == (want, len(want) // 2)
    return some


def case(spark, texts, length):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, n int"), length=length).collect()
    want = brute([(t or "").encode() for t in texts], length)
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == dict(enumerate(want))


def test_random_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 150))) for _ in range(30)]
    for _ in range(60):
        a = rng.choice(texts).split(" ")
        kind = rng.random()
        if kind < 0.5:
            for _ in range(rng.randint(1, 3)):
                a[rng.randrange(len(a))] = rng.choice(words)
        elif kind < 0.8:
            b, k = rng.choice(texts).split(" "), rng.randrange(len(a))
            m = rng.randrange(len(b))
            a[k:k] = b[m : m + rng.randint(5, 40)]
        texts.append(" ".join(a))
    texts += [None, "", "ab " * 90, "ab " * 70 + "c" + "ab " * 60, "x" * 300, texts[0], texts[0]]
    case(spark, texts, 48)
    case(spark, texts, 61)


def test_large_groups_are_settled_by_counts(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.repeats.LARGEST_GROUP", 2)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 14, 30)]
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 40))), rng.choice(passages), *(word() for _ in range(rng.randint(0, 40)))]) for _ in range(60)]
    case(spark, texts, 48)
    case(spark, texts, 61)


def test_runs_of_few_words_stay(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long_words, passage = " ".join(word(30) for _ in range(8)), " ".join(word(rng.randint(3, 8)) for _ in range(52))
    texts = [" ".join([*(word(6) for _ in range(20)), p, *(word(6) for _ in range(20))]) for p in (long_words, long_words, passage, passage)]
    got = words_case(spark, texts, 200, 50)
    assert [got[k][1] for k in range(4)] == [0, 0, 1, 1]


def test_a_very_long_text(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(120_000))
    passage = long[300_000:300_700]
    got = {r["id"]: (r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame([(1, long), (2, "Before " + passage + " after")], "doc_id long, text string")).collect()}
    assert got[1][1] == got[2][1] == 1 and 700 <= got[1][0] <= 702 and 700 <= got[2][0] <= 702


def test_empty_table(spark):
    case(spark, [], 400)
    case(spark, ["", None], 400)
