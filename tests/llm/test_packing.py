import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import _cuts, _places, arrange, pack, schedule
from tessera.llm.tokens import encoded

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_are_those_of_the_tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "é", "'s", "'", "12", "|", "&&&", "漢字", " ", "x", "\x1c", "<|endoftext|>", "\u0085", "🙂"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None, " ", "a ", " a"]
    got = [x.tolist() for x in encoded(pa.array(texts), RANKS, public_tokenizers.PATTERN)]
    assert got == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}])
def test_schedule_covers_all_places_once(weights):
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([8, 64, 100])
        tokens = {q: rng.choice([0, 1, 5, rng.randint(1, 3000)]) for q in "abcd"}
        seen = set()
        for q, parts in schedule(tokens, weights, size).items():
            at = 0
            while at < tokens[q]:
                n = min(rng.randint(1, 90), tokens[q] - at)
                done = at
                for offset, took, window, place in _cuts(parts, at, n, size):
                    assert offset == done and took > 0 and place + took <= size
                    done += took
                    for x in range(took):
                        assert (spot := window * size + place + x) not in seen
                        seen.add(spot)
                assert done == at + n
                at += n
        assert seen == set(range(sum(tokens.values())))


def test_shares_hold_in_every_window():
    tokens = {"a": 300_000, "b": 200_000, "c": 77_777}
    parts = schedule(tokens, {"a": 0.5, "b": 0.3, "c": 0.2}, 1000)
    got: dict = {}
    for q in tokens:
        for _, took, window, _ in _cuts(parts[q], 0, tokens[q], 1000):
            got[window, q] = got.get((window, q), 0) + took
    assert all(abs(got[w, q] - s) <= 1 for w in range(300) for q, s in (("a", 500), ("b", 300), ("c", 200)))


def test_many_sources_keep_their_shares_and_names():
    rng = random.Random(3)
    few = {f"s{k}": rng.randint(1, 60) for k in range(150)} | {"big": 6000, "wide": 3000}
    for tokens, size in ((few, 16), (few, 1000), ({f"s{k}": rng.randint(900, 1100) for k in range(1500)} | {"big": 3_000_000}, 65_536)):
        for weights in (None, {"big": 0.5, "s1": 0.25, "s2": 0.25}):
            paths = arrange(tokens, weights, size)
            assert paths.keys() == tokens.keys()
            got, spans = {}, []
            for q, n in tokens.items():
                end = 0
                for at, took, window, place in _places(paths[q], 0, n):
                    assert at == end and took > 0 and place + took <= size
                    end += took
                    spans.append((window * size + place, took))
                    got[q, window] = got.get((q, window), 0) + took
                assert end == n
            spot = 0
            for first, took in sorted(spans):
                assert first == spot
                spot += took
            if size == 65_536 and weights is None:
                whole = sum(tokens.values())
                for w in range(whole // size - 4):
                    assert abs(got["big", w] - size * tokens["big"] / whole) <= 17  # one token, and what rounding takes from 1024 queues: a 64th of a token from each
                    assert all(abs(got.get((f"s{k}", w), 0) - size * tokens[f"s{k}"] / whole) <= 40 for k in range(1500))


def test_packed_pieces_name_their_source_with_many_sources(spark):
    rows = [(k, "alpha beta " * (k % 7), f"s{k % 1100}") for k in range(2200)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), RANKS, public_tokenizers.PATTERN, length=64, window_sequences=4).select("id", "queue", "length", "doc_tokens").collect()
    assert all(p["queue"] == f"s{p['id'] % 1100}" for p in pieces)
    assert sum(p["length"] for p in pieces) == sum({p["id"]: p["doc_tokens"] for p in pieces}.values())


def test_pack_round_trip(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "é", "12"]) for _ in range(rng.choice([0, 3, 40, 700]))), rng.choice(["s", "t", None]), 1) for k in range(60)]
    rows += [(None, None, "s", 1), (3, rows[3][1], rows[3][2], 1)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string, n int"), RANKS, public_tokenizers.PATTERN, length=64, window_sequences=4).collect()
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for sequence, offset, length in places:
        assert sequence * 64 + offset == at and offset + length <= 64
        at += length
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if d is None else d, [*own.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _, _ in rows)
    assert at == sum(len(x) for _, x in want)
    one = [p for p in pieces if p["id"] == 5]
    ids = b"".join(bytes(p["ids"]) for p in sorted(one, key=lambda p: p["start"]))
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == dict(want)[5]
    assert not pack(spark.createDataFrame([], "doc_id long, text string, source string"), RANKS, public_tokenizers.PATTERN).collect()
