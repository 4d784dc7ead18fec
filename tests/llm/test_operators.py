"""Each operator against a brute-force version, on edge rows and on an empty table."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusmill.llm import decontaminate, line_cleaning, near_dedup, neural_lm, packing, pii, quality_classifier, suffix_dedup, token_codec, token_count

from .helpers import duplicate_components, edge_rows, frame, prose, shingles

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, edge_rows()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def texts():
    return [(r[0], r[1]) for r in edge_rows()]


def key(rows):
    return collections.Counter(tuple(map(str, r)) for r in rows)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [131_072, 20])
def test_token_counts(docs, empty, hot):
    got = key((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(docs, WORD, hot_limit=hot).collect())
    want = [(i, len((t or "").encode()), len(ids_of(WORD, t)), len(ids_of(WORD, t)) > 2048) for i, t in texts()]
    assert got == key(want)
    assert token_count.count_tokens(empty, WORD).count() == 0


def test_token_counts_of_long_units_in_every_row(spark):
    r = random.Random(21)
    line = "https://" + "".join(r.choice("abcdefgh/") for _ in range(200))
    rows = [(i, f"{prose(r, 20)} {line}\u2003{prose(r, 5)} \x01odd {'=' * 90} <|endoftext|>") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for hot in (1000, 3):
        got = {x["doc_id"]: x["n_tokens"] for x in token_count.count_tokens(d, WORD, hot_limit=hot).collect()}
        assert got == {i: len(ids_of(WORD, t)) for i, t in rows}
    assert max(map(len, map(token_count.wordjoin.unit_key, rows[0][1].split()))) <= 64 and line not in token_count.wordjoin.unit_key(line)


def test_token_blocks(docs, empty):
    got = token_codec.round_trip(docs, BYTE, 2, block_ids=700).collect()
    assert token_codec.round_trip(empty, BYTE, 2).count() == 0
    full = [(i, ids_of(BYTE, t) + [2]) for i, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    at, want = 0, []
    for i, ids in full:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert key((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == key(want)


def test_blocks_round_trip_and_detect_damage():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 5000, 70_000):
        ids = r.zipf(1.4, n) % 50_257
        block = token_codec.encode_block(ids, np.array([n] if n else []), 50_257)
        back, lengths, _ = token_codec.decode_block(block)
        assert (back == ids).all() and lengths.sum() == n
    ids = np.tile(r.integers(0, 70_000, 900), 70)
    back, lengths, doc_ids = token_codec.decode_block(token_codec.encode_block(ids, np.array([3, 62_997]), 70_000, [None, -5]))
    assert (back == ids).all() and lengths.tolist() == [3, 62_997] and doc_ids == [None, -5]
    for bad in (block[:-1], block[:40] + bytes([block[40] ^ 1]) + block[41:], b"LM", b"XXXX" + block[4:]):
        with pytest.raises(ValueError):
            token_codec.decode_block(bad)


def test_blocks_are_smaller_than_order_0_and_zlib(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toArrow().column(0).to_pylist()
    ids = np.concatenate(token_codec.CachedEncoder(BYTE).batch(texts))
    count = np.bincount(ids)
    share = count[count > 0] / len(ids)
    entropy, flat = -(share * np.log2(share)).sum(), 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 6)) / len(ids)
    bits = 8 * len(token_codec.encode_block(ids, np.array([len(ids)]), 50_258)) / len(ids)
    assert len(ids) > 500_000 and bits < entropy - 0.5 and bits < flat - 0.5


def test_cached_encoder_agrees_with_the_library():
    r = random.Random(41)
    parts = ["the", "An", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "<|endoftext|>", "<|endof", "'s", "'t", "é", "ß", "中", "\u2003", "\xa0", "\x1c", "\x85", "1", "23", ".", "!?", "word", "x" * 30, "\0", "\r", "a'", "\u0663", "\u0301"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(10_000)]
    even = [" ".join(r.choice(["the", "An", "x.", "é?", "it's", "1a", "中", "a\nb", ".", "\nq"]) for _ in range(r.randint(1, 9))) for _ in range(10_000)]
    library, texts = Tokenizer.from_file(BYTE), odd + even
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encode = token_codec.CachedEncoder(BYTE, bound=300)
    for k in range(0, len(texts), 500):
        assert [x.tolist() for x in encode.batch(texts[k : k + 500])] == want[k : k + 500]


def test_known_words_are_not_looked_up_again(monkeypatch):
    r = random.Random(31)
    encode = token_codec.CachedEncoder(BYTE)
    many = [prose(r, 200).replace(". ", ".\n") for _ in range(12)]
    want = [encode.library.encode(t, add_special_tokens=False).ids for t in many]
    looked, words = [], encode._words
    monkeypatch.setattr(encode, "_words", lambda names, cores: looked.extend(names) or words(names, cores))
    for _ in range(2):
        assert [x.tolist() for x in encode.batch(many)] == want
    assert len(looked) == len(set(looked))
    encode = token_codec.CachedEncoder(BYTE, bound=300)  # what a batch does not hold is forgotten, and learnt anew
    for k in (0, 1, 2, 3, 0, 2, 1):
        assert [x.tolist() for x in encode.batch(many[k : k + 1])] == want[k : k + 1]
        assert len(encode.known) <= 300


class Counting:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, library, given):
        self.library, self.given, self.model = library, given, library.model

    def encode(self, text, **options):
        self.given.append(text)
        return self.library.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given.extend(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_words_in_use_are_not_encoded_again_over_the_bound():
    library, given = Tokenizer.from_file(BYTE), []
    encode = token_codec.CachedEncoder(BYTE, bound=300)
    for name in ("library", "letters"):
        if getattr(encode, name, None) is not None:
            setattr(encode, name, Counting(getattr(encode, name), given))
    stems = ["".join(c) for c in itertools.islice(itertools.product("bdfgklmnprst", "aeiou\xe9", "bdglmnrst"), 200)]
    for k, tail in enumerate([",", ".", "!?", ");"]):
        text = " ".join(["start", *(w + tail for w in stems)])
        assert encode.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len("".join(given).split()) <= 202 + k  # each stem once, and the new punctuation


def test_batches_agree_with_the_library_on_line_starts_and_odd_letters():
    r = random.Random(43)
    words = ["the", "An", "it's", "x'", "\xaa\xb5\xba", "a\xd7b", "\xd7", "\xf7.", "\xdf!", "\xff),", "\u0101b,", "\xadz", "\ue000", "e\u0301.", "1.", "2b", "\u4e2d\u6587.", "...", "<|endof", "'s", "\u200bq", "a\xa0b", "a\x85b", "\x00"]
    texts = ["", None, "\n", "\nthe", "the\n", "<|endoftext|>", " ", "a <|endoftext|> b"]
    texts += ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\n\n"][: r.randint(3, 5)]) for _ in range(r.randint(1, 9))).strip(" " * r.randint(0, 1)) for _ in range(6000)]
    want = [ids_of(BYTE, t) if not t else e.ids for t, e in zip(texts, Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)]
    encode, column = token_codec.CachedEncoder(BYTE, bound=200), pa.array(texts, pa.large_string())
    for k in range(0, len(texts), 700):
        assert [x.tolist() for x in encode.batch(column.slice(k, 700))] == want[k : k + 700]


@pytest.mark.parametrize("salt", [250_000, 3])
def test_packing(docs, empty, salt):
    assert packing.pack(empty, WORD).count() == 0
    rows = packing.pack(docs, WORD, rows_per_salt=salt).collect()
    by_sequence, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.Counter()
    for i, t in texts():
        ids = ids_of(WORD, t) + [1]
        for a in range(0, len(ids), 2048):
            part = np.array(ids[a : a + 2048], "<u4").tobytes()
            want[(i, a, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert pieces == want


def test_patterns_cover_the_demand_closely():
    r = np.random.default_rng(1)
    demand = np.zeros(257, np.int64)
    for c in r.integers(1, 257, 6000):  # rounding costs at most a sequence a pattern
        demand[c] += 1
    found = packing.solve_patterns(demand, 256)
    made = sum(c * k for c, k in found)
    assert (made[1:] >= demand[1:]).all() and all((c * np.arange(257)).sum() <= 256 for c, _ in found)
    assert sum(k for _, k in found) <= 1.02 * (demand * np.arange(257)).sum() / 256 + 3


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(docs, empty, spark, small):
    assert near_dedup.near_duplicates(empty, 4).count() == 0
    r = random.Random(5)
    base = prose(r, 150).split()
    group = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(999))
        group.append((100 + i, " ".join(w)))
    rows = edge_rows()
    full = frame(spark, [*rows, *((i, t, *rows[0][2:]) for i, t in group)])
    found = near_dedup.near_duplicates(full, 4, small_bucket=small).collect()
    known = {i: t for i, t in [*texts(), *group] if i is not None}
    want = duplicate_components(known, 4)
    assert len(found) == len(rows) + 40
    for x in found:
        if x["doc_id"] is not None:
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(shingles(known[x["doc_id"]], 4)), want[x["doc_id"]], want[x["doc_id"]] == x["doc_id"])
    kept = near_dedup.keep_one(full, 4)
    assert kept.columns == full.columns
    assert sorted(x["doc_id"] for x in kept.filter("doc_id is not null").collect()) == sorted(i for i in want if want[i] == i)


@pytest.mark.parametrize("small", [32, 1])
def test_near_copies_without_id_are_linked(spark, small):
    r = random.Random(15)
    base = prose(r, 150).split()
    near = " ".join([*base[:70], "changed", *base[71:]])
    d = spark.createDataFrame([(7, " ".join(base)), (None, near), (8, prose(r, 100))], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(d, 4, small_bucket=small).collect()}
    assert (got[None]["component_id"], got[None]["kept"]) == (7, False)
    assert sorted(x["doc_id"] for x in near_dedup.keep_one(d, 4).collect()) == [7, 8]


def test_settled_links_of_a_large_group_are_not_met_again(spark, monkeypatch):
    r = random.Random(21)
    base, group = prose(r, 150).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(999))
        group.append((i, " ".join(w)))
    rows = {}

    def counted(df, label, n_files=None):
        out = stored(df, label, n_files)
        rows.setdefault(label, []).append(out.count())
        return out

    stored = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    found = near_dedup.near_duplicates(spark.createDataFrame(group, "doc_id bigint, text string"), 4, small_bucket=2).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == duplicate_components(dict(group), 4)
    assert sum(rows["adjacent"]) <= 2 * len(group)


def test_components_of_links_and_known_components(spark):
    r = random.Random(8)
    name = lambda i: b"%03d" % i
    schema = "a binary, b binary"
    chain, extra = [(i, i + 1) for i in range(0, 40)], [(r.randrange(200), r.randrange(200)) for _ in range(110)]
    edges = lambda pairs: spark.createDataFrame([(name(a), name(b)) for a, b in pairs], schema)
    got = near_dedup.components(edges(extra), near_dedup.components(edges(chain)))
    parent = list(range(200))
    for _ in range(200):
        for a, b in [*chain, *extra]:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {bytes(x["node"]): bytes(x["label"]) for x in got.collect()} == {name(i): name(parent[i]) for i in {i for e in [*chain, *extra] for i in e}}


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    shared, own = r.integers(0, 1 << 62, 900, dtype=np.uint64), r.integers(0, 1 << 62, 200, dtype=np.uint64)
    low = near_dedup.minima([np.unique(np.concatenate([shared, own[:100]])), np.unique(np.concatenate([shared, own[100:]]))])
    a, b = near_dedup.odd_sketches(low)
    differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in (a ^ b))
    assert differ < near_dedup.MAX_DIFFERENCE and near_dedup.band_keys(low).shape == (2, near_dedup.BANDS)


def _without_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeats(docs, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=9000).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == key(_without_repeats(texts()))


def test_repeats_of_one_chunk_listed_in_different_tasks(spark):
    r = random.Random(31)
    passage = prose(r, 30)
    rows = [(i, prose(r, 40) + " " + passage + " " + prose(r, 40)) for i in range(40)]
    n = 3 * spark.sparkContext.defaultParallelism  # the least number of chunks
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_chunk = collections.defaultdict(list)
    for x in d.selectExpr("doc_id", f"pmod(xxhash64(doc_id, text), {n}) AS chunk").collect():
        by_chunk[x["chunk"]].append(x["doc_id"])
    pair = next(v[:2] for v in by_chunk.values() if len(v) > 1)
    two = [rows[i] for i in pair]
    parted = spark.createDataFrame(spark.sparkContext.parallelize(two, 2), d.schema)
    assert parted.rdd.getNumPartitions() == 2
    got = suffix_dedup.remove_repeats(parted).collect()
    want = _without_repeats(two)
    assert want[1][2] >= len(passage)
    assert key((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == key(want)


def test_anchors_follow_content():
    r = random.Random(2)
    for data in (prose(r, 200).encode(), b"ab" * 200, b"x" * 90, bytes(60)):
        h, pos, first, last = suffix_dedup.anchors(data)
        windows = [(s, p, x) for x, p, a, b in zip(h, pos, first, last) for s in range(a, b + 1)]
        assert [s for s, _, _ in sorted(windows)] == list(range(len(data) - 49))
        seen = {}
        for s, p, x in windows:
            assert seen.setdefault(data[s : s + 50], (p - s, x)) == (p - s, x) and 0 <= p - s <= 30


def test_op5_anchors_of_a_repeating_text_take_no_step_a_place():
    import sys

    def calls(data: bytes) -> int:
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            suffix_dedup.anchors(data)
        finally:
            sys.setprofile(None)
        return len(seen)

    suffix_dedup.anchors(b"ab" * 100)
    assert calls(b"ab" * 50_000) == calls(b"ab" * 500)


def test_interval_tree_groups_are_exact():
    r = random.Random(8)
    text = ["".join(r.choice("ab") for _ in range(80)) for _ in range(12)]
    text += [t[:40] + text[0][40:] for t in text[:5]]
    rows = [(t[30:80].encode(), t[:30][::-1].encode(), 0, 30) for t in text]
    for o in range(31):
        want = collections.defaultdict(set)
        for i, t in enumerate(text):
            want[t[30 - o : 80 - o]].add(i)
        got = [set(g) for lefts, g in suffix_dedup.repeat_groups(rows) if o in lefts]
        assert sorted(map(sorted, got)) == sorted(sorted(g) for g in want.values() if len(g) > 1)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base_spans(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group()))


TRICKY = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3.999999999999", "a.@b.c.d..e@f.g", "4111-1111 1111 1111-9 4111111111111111", "+12345678901+1 (2) 3-4.5 678 9012", "++1 2", "x@y @z.w a@b", "é 4111111111111111é a@b.cé"]


def test_personal_data(docs, empty, spark):
    model = pii.Model(spark)
    assert pii.digest(empty, model).count() == 0 and pii.redact(empty, model).count() == 0
    rows = edge_rows()
    full = docs.union(frame(spark, [(200 + i, t, *rows[0][2:]) for i, t in enumerate(TRICKY)]))
    known = [*texts(), *((200 + i, t) for i, t in enumerate(TRICKY))]
    got = pii.digest(full, model).collect()
    want = []
    for i, t in known:
        s = _base_spans(t)
        listed = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(k == j for _, k, _ in s) for j in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    assert key((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == key(want)
    red = pii.redact(docs, model)
    assert red.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in red.collect()}
    assert text[9].startswith("mail <EMAIL> or <PHONE>, <IP>; <CARD>") and text[1] is None and text[0] == edge_rows()[0][1]


def test_personal_data_model_marks_secrets(spark):
    d = spark.createDataFrame([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'), (2, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 y"), (3, "plain words only here")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(d).collect()}
    assert got[1].startswith("secret:2:") and got[2] == "" and got[3] == ""


def test_personal_data_marks_long_secrets_whole(spark):
    r = random.Random(3)
    token = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(600))
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(512))
    d = spark.createDataFrame([(1, f'x token = "{token}" y'), (2, f'the secret key: "{hexa}" y')], "doc_id bigint, text string")
    model = pii.Model(spark)
    got = {x["doc_id"]: x["spans"] for x in pii.digest(d, model).collect()}
    text = {x["doc_id"]: x["text"] for x in pii.redact(d, model).collect()}
    assert token[-40:] not in text[1] and hexa[-40:] not in text[2], got
    assert got[1].startswith("secret:2:") and got[2].startswith("secret:")


def test_personal_data_in_texts_with_very_many_matches(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(5))
    parts, at, n = [], 0, 50_000
    for i in range(n):
        parts.append(f"{word()} u{i}@ex.org" + (" token=" + "k3J9" * 250 if i % 5000 == 7 else "") + (" +1 (017) 555-7713" if i % 3 == 0 else ""))
    text = " ".join(parts)
    model = pii.Model(spark)
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.monotonic()
    got = pii.digest(d, model).first()
    assert (got["n_email"], got["n_phone"], got["spans"].count("secret")) == (n, len(range(0, n, 3)), 10)
    base = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in _base_spans(text))
    assert got["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    red = pii.redact(d, model).first()["text"]
    assert red.count("<EMAIL>") == n and "@" not in red and "555" not in red and "k3J9" not in red and time.monotonic() - began < 60
    want, place = [], 0
    spans = sorted((int(x.split(":")[1]), list(pii.KINDS).index(x.split(":")[0]), int(x.split(":")[2])) for x in got["spans"].split(","))
    for a, k, b in spans:
        if a >= place:
            want += [text[place:a], f"<{pii.KINDS[k].upper()}>"]
        place = max(place, b)
    assert red == "".join([*want, text[place:]])


def test_line_cleaning(docs, empty):
    assert line_cleaning.digest(empty).count() == 0
    got = line_cleaning.digest(docs).collect()
    want = []
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice), failed))
    assert key((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == key(want)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    clean = line_cleaning.keep_clean(docs)
    assert clean.columns == docs.columns and 0 in {r["doc_id"] for r in clean.collect()}


def test_line_rules(spark):
    r = random.Random(12)
    good = "\n".join(prose(r, 15) for _ in range(12))
    bad = "Home | About | Contact | News\n" * 6
    d = spark.createDataFrame([(1, good), (2, good + "\n" + bad), (3, bad * 20 + good[:60])], "doc_id bigint, text string")
    got = {r["row"]["doc_id"]: r for r in line_cleaning.clean_lines(d).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == good
    assert got[2]["kept"] and "Home" not in got[2]["cleaned_text"]
    assert not got[3]["kept"]


def test_decontamination(docs, empty, spark):
    item = prose(random.Random(77), 40)
    bench = spark.createDataFrame([(5, item), (6, item), (7, None), (8, "short"), (None, prose(random.Random(78), 40))], "item_id bigint, text string")
    assert decontaminate.find_items(empty, bench).count() == 0
    near = item[:50] + "zq" + item[51:120] + item[122:]
    rows = edge_rows()
    d = docs.union(frame(spark, [(300, "before it " + item.upper() + " after", *rows[0][2:]), (301, "x " + near + " y", *rows[0][2:]), (302, item[: len(item) // 2], *rows[0][2:])]))
    for block in (16_000_000, 50):
        got = {r["doc_id"]: r for r in decontaminate.find_items(d, bench, block).collect()}
        assert {i for i, r in got.items() if r["contaminated"]} == {300, 301}
        assert got[300]["passages"] == f"5:10:{10 + len(item)}:0" and got[301]["item_id"] == 5 and 0 < got[301]["edits"] <= 5
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and kept.count() == d.count() - 2
    assert decontaminate.drop_contaminated(d, bench.limit(0)).count() == d.count()


def test_decontamination_recall():
    r = random.Random(4)
    items = [(i, prose(r, 35)) for i in range(40)]
    match, hit = decontaminate.Matcher(items), 0
    for n in range(150):
        i, t = r.choice(items)
        s = list(t)
        for _ in range(int(len(t) * decontaminate.BUDGET)):
            p = r.randrange(len(s))
            s[p : p + r.randint(0, 1)] = r.choice(["", "q", "z"])
        hit += any(f[0] == i for f in match([prose(r, 20) + "".join(s) + prose(r, 20)])[0])
    assert hit >= 147
    assert decontaminate.distance_within("kitten", "xxsittingxx", 3)[0] == 2


def test_decontamination_recall_against_brute_force():
    r = random.Random(6)
    items = [(i, prose(r, 50)) for i in range(60)]
    cases = []
    for _ in range(3000):
        i, t = r.choice(items)
        s = list(t)
        for _ in range(int(len(t) * decontaminate.BUDGET)):
            p, kind = r.randrange(len(s)), r.randrange(3)
            s[p : p + (kind != 1)] = [] if kind == 0 else [r.choice("aeinorst qz")]
        cases.append((i, prose(r, 5) + " " + "".join(s) + " " + prose(r, 5)))
    by_id = {i: decontaminate.fold(t) for i, t in items}
    true = [decontaminate.distance_within(by_id[i], decontaminate.fold(t), int(len(by_id[i]) * decontaminate.BUDGET)) is not None for i, t in cases]
    found = decontaminate.Matcher(items)([t for _, t in cases])
    hit = [any(f[0] == i for f in fs) for (i, _), fs in zip(cases, found, strict=True)]
    assert sum(true) >= 2900 and sum(h for h, w in zip(hit, true, strict=True) if w) >= decontaminate.RECALL * sum(true)


def test_decontamination_against_every_place(spark):
    r = random.Random(16)
    items = [(i, prose(r, 12 + 3 * i)) for i in range(14)]
    rows = []
    for n in range(120):
        text = prose(r, 60)
        if n % 2:
            s = list(r.choice(items)[1])
            for _ in range(r.randint(0, int(len(s) * 1.5 * decontaminate.BUDGET))):
                s[r.randrange(len(s))] = r.choice("aeiq ")
            text += " " + "".join(s) + " " + prose(r, 20)
        rows.append((n, text))
    want = {}
    for n, text in rows:
        hits = [(d[0], i) for i, t in items if (d := decontaminate.distance_within(decontaminate.fold(t), decontaminate.fold(text), int(len(t) * decontaminate.BUDGET)))]
        want[n] = min(hits, default=None)
    d, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {x["doc_id"]: x for x in decontaminate.find_items(d, bench).collect()}
    assert sum(w is not None for w in want.values()) > 25
    assert {n: (x["edits"], x["item_id"]) if x["contaminated"] else None for n, x in got.items()} == want


def test_decontamination_of_repetitive_texts_and_unnamed_items(spark):
    found = [(n % 3, 7 * n, 7 * n + 30, n % 5) for n in range(200_000)]
    began = time.monotonic()
    kept = decontaminate.best_of(found)
    assert time.monotonic() - began < 10
    for n in range(3):
        mine = [k for k in kept if k[0] == n]
        assert all(a[2] <= b[1] for a, b in zip(mine, mine[1:], strict=False))
    item = prose(random.Random(3), 30)
    bench = spark.createDataFrame([(None, item)], "item_id bigint, text string")
    x = decontaminate.find_items(spark.createDataFrame([(1, "so " + item)], "doc_id bigint, text string"), bench).first()
    assert x["contaminated"] and x["item_id"] is None and x["passages"] == f"null:3:{3 + len(item)}:0"


def test_lm_scores(docs, empty, spark):
    assert neural_lm.score_texts(empty).count() == 0
    words = lambda t: (t or "").encode().lower().split()
    train = [t for i, t in texts() if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in words(t))
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    for hot in (131_072, 10):
        got = neural_lm.score_texts(docs, hot_limit=hot).collect()
        assert len(got) == len(texts())
        by_id = dict(texts())
        for r in got:
            w = [*words(by_id[r["doc_id"]]), None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), rel=1e-9)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0


def _plain_log10(model, symbols, words):
    """The model's log10 probability of each symbol of a text and of its end mark, spelt out."""
    r, d, qc, bc, qw, bw = (p.astype(float) for p in model.params)
    s = [symbols.end] * neural_lm.CONTEXT + [symbols.of(w) for w in words] + [symbols.end]
    out = []
    for k in range(neural_lm.CONTEXT, len(s)):
        h = sum(r[s[k - 1 - i]] * d[i] for i in range(neural_lm.CONTEXT))
        c, j = divmod(s[k], neural_lm.MEMBERS)
        w = slice(c * neural_lm.MEMBERS, (c + 1) * neural_lm.MEMBERS)
        soft = lambda x, i: x[i] - x.max() - math.log(np.exp(x - x.max()).sum())
        out.append((soft(qc @ h + bc, c) + soft(qw[w] @ h + bw[w], j)) / math.log(10))
    return out


def test_lm_scores_against_brute_force(spark, monkeypatch):
    r = random.Random(51)
    rows = [(i, prose(r, r.randint(0, 60)) if i else None) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = {}
    keep = neural_lm.fit
    monkeypatch.setattr(neural_lm, "fit", lambda docs, model, frequent, **o: made.setdefault("m", (keep(docs, model, frequent, **o), frequent))[0])
    monkeypatch.setattr(neural_lm, "FREQUENT", 40)
    got = {x["doc_id"]: x["score"] for x in neural_lm.score_texts(d, hot_limit=10).collect()}
    model, frequent = made["m"]
    assert len(frequent) == 40
    symbols = neural_lm.Symbols(frequent)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in (t or "").encode().lower().split())
    n, v = collections.Counter(), collections.Counter()
    for w, k in c.items():
        n[symbols.of(w)] += k
        v[symbols.of(w)] += 1
    n[symbols.end], v[symbols.end] = len(train), 1
    for i, t in rows:
        words = (t or "").encode().lower().split()
        inside = [math.log10(((c[w] if w else len(train)) + 1) / (n[s] + v[s] + 1)) for w, s in [*((w, symbols.of(w)) for w in words), (None, symbols.end)]]
        assert got[i] == pytest.approx(sum(_plain_log10(model, symbols, words)) + sum(inside), rel=1e-4)


def test_lm_is_normalised_and_learns():
    r = random.Random(3)
    words = [prose(r, 1).rstrip(".").encode() + b"%d" % i for i in range(600)]
    follow = {w: r.sample(words, 3) for w in words}

    def text():
        w, out = r.choice(words), []
        for _ in range(200):
            out.append(w)
            w = r.choice(follow[w])
        return b" ".join(out).decode()

    train, held = [text() for _ in range(2000)], [text() for _ in range(20)]
    symbols = neural_lm.Symbols(words)
    counts = np.bincount(symbols.tokens(train)[0][symbols.tokens(train)[1]], minlength=neural_lm.SYMBOLS)
    model = neural_lm.Model(counts, symbols)
    flat, at, _ = symbols.tokens(held)
    before = model.log_probs(flat, at).mean()
    model.train(symbols.tokens(train[k : k + 50])[:2] for k in range(0, len(train), 50))
    after = model.log_probs(flat, at).mean()
    unigram = np.log10(counts[flat[at]] / counts.sum()).mean()
    assert after > before + 0.3 and after > unigram + 0.3
    total = np.zeros(5)
    for s in range(neural_lm.SYMBOLS):  # over all that may follow five contexts
        some = np.concatenate([[*flat[at[k] - 3 : at[k]], s] for k in range(5)])
        total += 10 ** model.log_probs(some.astype(np.int32), np.arange(5) * 4 + 3)
    assert np.allclose(total, 1, atol=1e-4)


def test_lm_training_step_against_plain_slopes(monkeypatch):
    r = np.random.default_rng(12)
    words = [b"w%d" % i for i in range(300)]
    symbols = neural_lm.Symbols(words)
    flat, at, _ = symbols.tokens([" ".join(f"w{k}" for k in r.integers(0, 330, 50)) for _ in range(6)])
    model = neural_lm.Model(np.bincount(flat[at], minlength=neural_lm.SYMBOLS).astype(float), symbols)
    m, k, rng = neural_lm.MEMBERS, neural_lm.NOISE, np.random.default_rng(17)
    vec, place, qc, bc, qw, bw = (p.astype(float) for p in model.params)
    drawn = {None: rng.choice(neural_lm.CLASSES, k, p=model.class_draw)}
    for c in np.unique(flat[at] // m):
        drawn[c] = c * m + np.searchsorted(model.member_draw[c], rng.random(k))
    want = [np.zeros_like(x) for x in (vec, place, qc, bc, qw, bw)]
    for a in at:
        context, target = [flat[a - 1 - i] for i in range(neural_lm.CONTEXT)], flat[a]
        h, back = sum(vec[c] * place[i] for i, c in enumerate(context)), 0
        for q, b, gq, gb, noise, true, names in ((qc, bc, want[2], want[3], model.class_noise, target // m, drawn[None]), (qw, bw, want[4], want[5], model.member_noise.ravel(), target, drawn[target // m])):
            for name, is_true in [(true, True), *((x, False) for x in names)]:
                p = 1 / (1 + k * float(noise[name]) * np.exp(-(h @ q[name] + b[name])))
                slope = 1 - p if is_true else -p
                back = back + slope * q[name]
                gq[name] += slope * h
                gb[name] += slope
        for i, c in enumerate(context):
            want[1][i] += back * vec[c]
            want[0][c] += back * place[i]
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or bincount(*a, **b))
    sums = [np.zeros_like(p) for p in model.params]
    with np.errstate(all="ignore"):
        model.step(flat, at, sums, 0.0, np.random.default_rng(17))
    for got, x in zip(sums, want, strict=True):
        assert np.allclose(np.sqrt(got), np.abs(x), atol=1e-3)
    # one pass a column for the contexts together, and one at each level
    assert len(calls) <= 3 * (neural_lm.DIM + 1)


def test_lm_models_are_averaged_by_their_tokens(spark, monkeypatch):
    r = random.Random(5)
    d = spark.createDataFrame([(i, prose(r, 30)) for i in range(40)], "doc_id bigint, text string").repartition(9)
    words = sorted({w for x in d.collect() for w in x["text"].encode().lower().split()})
    symbols = neural_lm.Symbols(words)
    flat, at, _ = symbols.tokens([x["text"] for x in d.collect()])
    counts = np.bincount(flat[at], minlength=neural_lm.SYMBOLS)
    flatly = neural_lm.fit(d, neural_lm.Model(counts, symbols), words, rounds=1)
    monkeypatch.setattr(neural_lm, "AVERAGED", 2)
    by_tree = neural_lm.fit(d, neural_lm.Model(counts, symbols), words, rounds=1)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(flatly.params, by_tree.params, strict=True))
    assert not np.allclose(flatly.params[4], neural_lm.Model(counts, symbols).params[4])


def test_quality(docs, empty, spark):
    r = random.Random(1)
    rows = edge_rows()
    good = [(1000 + i, prose(r, r.randint(60, 200)), *rows[0][2:]) for i in range(150)]
    bad = [(2000 + i, " | ".join(prose(r, r.randint(60, 200)).split()), *rows[0][2:]) for i in range(150)]
    d = docs.union(frame(spark, [*good, *bad]))
    labels = spark.createDataFrame([*((g[0], 1, 0) for g in good), *((b[0], 0, 0) for b in bad), (None, 1, 0), (1000, None, 0), (1001, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(d, labels).collect()
    assert len(got) == d.count() and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] >= 1000]
    assert sum(x["predicted"] == (x["doc_id"] < 2000) for x in held) >= 0.97 * len(held)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {round(x["score"], 6) for x in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
