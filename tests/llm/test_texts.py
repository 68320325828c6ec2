"""Operators on texts against brute force: the smallest tables, and rows with nulls, empty and long texts,
repeats and extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedside.llm import bpe, common, decontaminate, lines, ngrams, pii, quality, queries, shards, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, _row string, spans int, score double, ids string"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents: (id, text)."""
    common.prepare(spark)
    a = " ".join(f"word{i}" for i in range(120))
    near = [" ".join(f"w{i}" if i != 10 * k else f"x{k}" for i in range(90)) for k in range(9)]
    texts = [None, "", " ", "\n\n", "one", "One two", a, a, a.upper(), a[30:] + " tail", a + "\n" + a, "x" * 50_000,
             "é ñ ü\n  12 a@b.co 1.2.3.4 +1 (017) 555-7713 4785380592391139", *near,
             "line one of some forty bytes, more or less\nline two of some forty bytes, more or less\nthird",
             "line two of some forty bytes, more or less\nline one of some forty bytes, more or less\nline three is new"]
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    return [*rows, rows[6], rows[6]]  # one document three times


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i and i % 3 == 0 else f"s{(i or 0) % 2}", "r", 1, 2.0, "i") for i, t in rows], SCHEMA)


def table(spark):
    return pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None)


def everything(spark, odd):
    return [(i + 1000, t) for i, t in table(spark)] + odd


# -- byte-level BPE

def test_bpe_equals_the_library_and_decodes(spark, odd):
    import tiktoken
    path, pattern = queries.vocabulary()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [*everything(spark, odd), (5000, "<|endoftext|>  a\t b \r\n c's don't"), (5001, "a" * 3000)]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark, rows), path, pattern).collect())
    want = Counter()
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
    assert got == want


def test_bpe_decode_alone(spark, odd):
    path, pattern = queries.vocabulary()
    ids = bpe.encode(frame(spark, odd), path, pattern)
    got = Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(ids, path).collect())
    assert got == Counter((i, (t or "").encode()) for i, t in odd)
    assert bpe.digests(frame(spark, []), path, pattern).count() == 0


# -- decontamination

@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_marks_what_brute_force_marks(spark, odd, block_bytes):
    items = [(1, " ".join(f"word{i}" for i in range(20, 40))), (2, "One, TWO"), (3, ""), (4, None), (5, "word0"), (12, "x2 w21"),
             (1, "repeated id w30"), (None, "w40 w41")]
    items += [(100 + i, t) for i, t in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples(index=False, name=None)]
    patterns = {}
    for i, t in items:
        w = folded(t)
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            patterns.setdefault(tuple(w[k:k + 13]), set()).add(i)
    rows, want = everything(spark, odd), Counter()
    for i, t in rows:
        w, hit, found = folded(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                who = patterns.get(tuple(w[k:k + m]))
                if who:
                    found |= who - {None}
                    hit |= set(range(k, k + m))
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, ["doc_id"], block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        {i: n for (i, words, hit, _), n in want.items() if not (hit and 20 * hit >= words)})
    assert decontaminate.scan(docs, bench.limit(0), ["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0


# -- substrings

def brute_substrings(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            p = tuple(w[k:k + window])
            if i is not None:
                first[p] = min(first.get(p, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("window,k", [(50, 8), (6, 3)])
def test_substrings(spark, odd, window, k):
    rows = everything(spark, odd) + [(None, odd[6][1]), (7, "another text of the same id")]
    got = substrings.remove(frame(spark, rows), ["doc_id"], window=window, k=k).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == brute_substrings(rows, window)


def test_substrings_repetitive_texts(spark):
    rows = [(1, "a b " * 60), (2, "b a " * 40 + "c"), (3, "a " * 70), (4, "a " * 51), (5, "c " + "a " * 50 + "d"), (6, None)]
    got = substrings.remove(frame(spark, rows), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == brute_substrings(rows, 50)
    assert substrings.digests(frame(spark, [])).count() == 0


# -- n-gram join

def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = folded(t)
        m = min(5, len(w))
        sets.append({tuple(w[k:k + m]) for k in range(len(w) - m + 1)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("pair_bucket,block", [(16, 256), (2, 4)])
def test_ngram_classes(spark, odd, pair_bucket, block):
    near = [(200 + k, " ".join(f"n{i}" if i != 7 * k % 97 else f"y{k}" for i in range(97))) for k in range(24)]
    rows = everything(spark, odd) + near
    got = ngrams.classes(frame(spark, rows), pair_bucket=pair_bucket, block=block).collect()
    assert Counter((r.doc, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_ngram_representatives(spark, odd):
    docs = frame(spark, [*odd, (None, "a text without an id"), (None, None)])
    kept = ngrams.representatives(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 3 and ids[8] == ids[9] == 0 and ids[14] == 1 and not any(ids[i] for i in range(15, 23)) and ids[None] == 2
    assert ngrams.representatives(frame(spark, [])).count() == 0


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = ngrams.bands_and_rows(s, recall, 200)
        assert 1 - (1 - s ** rows) ** bands >= recall and bands * rows <= 200


# -- lines

def test_alignment_is_common_and_rising():
    a, b = list("abcabdxyz"), list("zabcabcabdyx")
    pairs = lines.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert lines.align([], ["a"]) == [] and lines.align(["a", "b"], ["a", "b"]) == [(0, 0), (1, 1)]
    assert lines.align([None, "q"], ["r", None]) == []


def brute_lines(rows, white=" "):
    """(id, lines, removed, text) where every document is aligned with every earlier one."""
    stripped = {i: [x.strip(white) or None for x in t.split("\n")] for i, t in rows if t is not None}
    want = Counter()
    for i, t in rows:
        if t is None:
            want[i, 0, 0, None] += 1
            continue
        raw, gone = t.split("\n"), set()
        for o in stripped:
            if o < i:
                for s, e in lines.blocks(stripped[i], [len(x.encode()) for x in raw], stripped[o], lines.MIN_BYTES):
                    gone |= set(range(s, e))
        want[i, len(raw), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in gone)] += 1
    return want


def lined(spark, rows):
    return Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.result(frame(spark, rows)).collect())


def test_lines_against_brute_force(spark, odd):
    rows = everything(spark, odd)
    assert lined(spark, rows) == brute_lines(rows, lines.WHITE)


def test_lines_shared_with_documents_that_are_first_for_no_line(spark):
    common.prepare(spark)
    a, b = "a line of 25 bytes or more", "b line of 25 bytes or more"
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{b}")]
    assert {r.doc_id: r.text for r in lines.result(frame(spark, rows)).collect()}[4] == ""
    assert lined(spark, rows) == brute_lines(rows)
    p, q = "p is a long line of some forty bytes, more or less", "q is a long line of some forty bytes, more or less"
    rows = [(1, f"{p}\nx\n{q}"), (2, f"{q}\n{p}"), (3, f"{q}\n{p}"), (4, f"{q}\n{p}\ny"), (5, f"{q}\n{p}\nz")]
    assert {r.doc_id: r.text for r in lines.result(frame(spark, rows)).collect()}[5] == "z"
    assert lined(spark, rows) == brute_lines(rows)


def test_lines_of_other_white_space_are_equal(spark):
    common.prepare(spark)
    a = [f"line {k} of 20 bytes" for k in range(4)]
    rows = [(1, "\n".join([*a[:2], "", *a[2:]])), (2, "\r\n".join([*a[:2], "", *a[2:]])), (3, "\n".join(["\t" + a[0], f"{a[1]}\v\f", " \t", *a[2:]]))]
    got = lined(spark, rows)
    assert got == brute_lines(rows, " \t\r\f\v") and {(i, n) for i, _, n, _ in got} == {(1, 0), (2, 5), (3, 5)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_lines_against_all_earlier_documents(spark, seed):
    import random
    common.prepare(spark)
    rng = random.Random(seed)
    pool = ["", "  ", "{", *[f"{k} {'short' * (k % 3)}" for k in range(8)], *[f"line {k} of some forty bytes, a little more or less" for k in range(5)],
            *[f"{' ' * (k * 6)}padded {k}" for k in range(4)], "padded 2", "padded 3   "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(1, 161)]
    assert lined(spark, rows) == brute_lines(rows)


def test_lines_stage_keeps_columns_and_clean_rows(spark, odd):
    docs = frame(spark, [*odd, (None, None), (None, "alone")])
    left = lines.shortened(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[1] == ids[2] == ids[3] == ids[4] == 1 and ids[7] == 3 and ids[8] == 0 and ids[None] == 2
    assert lines.result(frame(spark, [])).count() == 0


# -- personal data

def brute_spans(text):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or k == 0 or (k == 3 and 10 <= len(d) <= 15) or (
                    k == 2 and 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    import random
    random.seed(3)
    texts = ["".join(random.choice("ab1290.@+- ()%_\n0é") for _ in range(random.randint(0, 80))) for _ in range(4000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 5 +1 (017) 555-7713", "4785 3805 9239 1139", "@@a@b.cc", "0001.2.3.255"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_keeps_base_spans_and_finds_more(spark, odd):
    extra = [(900, "call (017) 555-7713 now"), (901, "on 2024-01-15 at 10:30 version 3.11.4, sha 9f86d081884c7d659a2f"),
             (902, "1 " * 30_000), (903, "7" * 20_000)]
    rows = everything(spark, odd) + [(2000 + i, t) for i, t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[
        ["doc_id", "text"]].itertuples(index=False, name=None)] + extra
    got = {}
    for r in pii.digests(frame(spark, rows)).collect():
        got[r.doc_id] = r
    for i, t in rows:
        base = brute_spans(t)
        assert got[i].base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(got[i].spans.split(","))
    assert got[900].spans.startswith("phone:") and got[901].spans == ""
    assert pii.digests(frame(spark, [])).count() == 0


def test_field_sums_to_one():
    case = pii.Lattice("call 555-7713 or 10.0.0.1", 0, 25, [])
    m = case.marginals(pii.np.random.default_rng(0).normal(size=(4, pii.N_FEATURES)))
    assert (m >= 0).all() and (m <= 1 + 1e-9).all() and case.segments


# -- quality

def test_quality_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op8_quality_boosted_trees"](spark, sf).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    rank, ones = held.score.rank(), (held.quality == 1).sum()
    auc = (rank[held.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(held) - ones))
    assert auc > 0.95 and held[held.quality == 1].predicted.mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_quality_without_labels_and_with_one_kind(spark, odd):
    docs = frame(spark, odd)
    none = quality.digests(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert {r.score for r in none.collect()} == {0.5} and none.count() == len(odd)
    ones = quality.digests(docs, spark.createDataFrame([(i, 1) for i, _ in odd] * 2, "doc_id long, quality int")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5
    kept = quality.accepted(docs, spark.createDataFrame([(i, i % 2) for i, _ in odd], "doc_id long, quality int"))
    assert kept.columns == docs.columns
    assert quality.digests(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# -- shards

@pytest.mark.parametrize("n,bucket_rows", [(16, 200_000), (40, 7)])
def test_shards_are_even_gapless_and_mixed(spark, odd, n, bucket_rows):
    rows = everything(spark, odd)
    docs = frame(spark, rows).withColumn("_rank", F.lit(1)).withColumn("_bucket", F.lit(2))
    got = shards.interleave(docs, n, bucket_rows=bucket_rows).toPandas()
    sizes = got._shard.value_counts()
    full = [sizes.get(k, 0) for k in range(n)]
    assert max(full) - min(full) <= 1 and sum(full) == len(rows)
    for _, part in got.groupby("_shard"):
        assert sorted(part._slot) == list(range(len(part)))
    mix = got.assign(source=got.source.fillna("none")).pivot_table(index="_shard", columns="source", values="_slot", aggfunc="count", fill_value=0)
    assert (mix.max() - mix.min()).max() <= 2 or n == 40


def test_shard_digests(spark, odd):
    got = Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in shards.assignment(frame(spark, odd)).collect())
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for i, t in odd)
    assert shards.assignment(frame(spark, [])).count() == 0
