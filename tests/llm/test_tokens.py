"""Packing and token alignment against the tokenizer libraries and brute force."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bedside.llm import alignment, common, packing, queries
from bedside.llm.remembered import Remembered

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, piece string, _key int, ids string, length string"


def odd_texts():
    return [None, "", " ", "\n\n", "one", "One two", "a  b", " lead", "trail ", "x" * 30_000, "é ñ ü ŉ ﬁ １ İ ΣΑΣ ä ̈b",
            "tab\tand\r\nline\x1cfs\x85nel　wide sep", "<|endoftext|> and <|startoftext|>x", "it's I'll we'VE", "▁x ▁ x▁y", "\x00 nul",
            "word " * 6000, "the the the", "the the the", "日本語 テキスト", "🙂 🙃🙂"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1, "i", "l") for i, t in rows], SCHEMA)


def documents():
    return [*pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None)]


def test_what_is_remembered_is_forgotten_by_bytes():
    learnt = []

    def learn(new):
        learnt.append(len(new))
        return {"codes": (np.array([len(s) for s in new]), np.array([ord(c) for s in new for c in s]))}

    pool, rng = Remembered(learn, {"codes": np.int64}, 5_000), random.Random(2)
    for _ in range(60):
        keys = ["".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 40))]
        flat, lengths = pool.take(keys, "codes")
        assert "".join(map(chr, flat)) == "".join(keys) and lengths.tolist() == [len(k) for k in keys]
    assert sum(learnt) > 150 and len(pool.number) < 60  # forgotten more than once


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 2048])
    least = rng.choice([1, 3, capacity // 32 + 1])
    h = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 50, 500])) for _ in range(rng.randint(1, rng.choice([2, 10, 100])))}
    slots, sequences = packing.Slots(packing.place(h, capacity, least)), defaultdict(list)
    for length, n in h.items():
        got = defaultdict(list)
        for found, start, part, sequence, offset in slots.find(np.full(n, length), np.arange(n)):
            for i, s, p, q, o in zip(*(x.tolist() for x in (found, start, part, sequence, offset)), strict=True):
                got[i].append((s, s + p))
                sequences[q].append((o, o + p))
        assert sorted(got) == list(range(n))
        for parts in got.values():  # gapless, whole
            assert [a for a, _ in sorted(parts)] + [length] == [0] + [b for _, b in sorted(parts)]
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        assert [0] + [b for _, b in sorted(parts)][:-1] == [a for a, _ in sorted(parts)] and max(b for _, b in parts) <= capacity
    total = sum(k * n for k, n in h.items())
    if least == 1:  # no sequence more than the ids need
        assert len(sequences) == -(-total // capacity)
    assert packing.place({}).shape == (0, len(packing.SLOT))


def test_shortest_pack_goes_first():
    # 10 | 6+3 | 5+4 -> 3 goes to the pack of 5 while it is the shortest, 4 before it
    slots = packing.place({10: 1, 6: 1, 5: 1, 4: 1, 3: 1}, 10, 1).tolist()
    at = {s[1]: s[6] for s in slots if s[4] == 0}
    assert at[4] == at[5] and at[3] == at[6] and len(set(at.values())) == 3


@pytest.mark.parametrize("capacity,least", [(2048, 64), (32, 1)])
def test_packing_holds_the_ids_of_the_tokenizer(spark, capacity, least):
    import public_tokenizers
    from tokenizers import Tokenizer
    common.prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*documents(), *((10_000 + i, x) for i, x in enumerate(odd_texts())), (7, "twice"), (7, "twice"), (None, "no key")]
    if capacity < 100:
        rows = rows[-60:]
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in rows)
    got = packing.pack(frame(spark, rows).repartition(3), path, capacity, least=least, with_ids=True).collect()
    plain = packing.pack(frame(spark, rows).repartition(3), path, capacity, least=least).drop("ids").collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.length, r.ids_crc32) for r in plain)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = struct.unpack(f"<{r.length}I", r.ids)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(ids) == r.length
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    found = Counter()
    for (i, n), parts in docs.items():
        by_start = defaultdict(list)
        for s, ids in parts:
            by_start[s].append(ids)
        if len(by_start) == len(parts):
            whole = tuple(x for _, ids in sorted(parts) for x in ids)
            assert len(whole) == n and [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(len(x) for _, x in sorted(parts))])[:-1])
            found[i, whole] += 1
        else:
            found[i, by_start[0][0]] += len(by_start[0])  # rows of equal key, each one piece
    assert found == want
    total = sum(len(ids) * c for (_, ids), c in want.items())
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= capacity
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= total / capacity * 1.04 + 1


@pytest.mark.parametrize("suffix", ["</w>", None])
def test_strings_meet_the_dictionaries_once_a_buffer(suffix):
    import public_tokenizers
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.loads(f.read())
    spec["model"]["end_of_word_suffix"] = suffix  # without one the model's ids cannot be told apart by it
    t, encoder = Tokenizer.from_str(json.dumps(spec)), packing.Encoder(json.dumps(spec))
    known, sent = Remembered(encoder.learn, {"ids": np.uint32}), []
    words, encoder.words.learn = encoder.words.learn, lambda new: sent.append(new) or words(new)
    looked, find = [], known.find
    known.find = lambda keys: looked.append(keys) or find(keys)
    texts = [None, "", " ", "\n", "Don't stop,don't", "Caf\u00c9 na\u00efve  </w> a</w>b", "\u5b57 \u0130\u017f <|endoftext|> e\u0301", *odd_texts(), *["the end of the day's end, the end"] * 50]
    for batch in (texts, texts[::-1], [None], ["the"]):
        ids, ends = packing.encoded(pa.array(["left out", *batch], pa.string()).slice(1), known)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in batch]
    assert len(looked) == 4 and all(len(keys) == len(set(keys)) for keys in looked)
    assert len(sent) == 1 and len(sent[0]) == len(set(sent[0]))


def test_packing_of_nothing(spark):
    import public_tokenizers
    assert packing.pack(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# -- alignment

def brute_alignment(rows):
    """doc rows to figures, with whole texts given to both libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    done, holds = [], Counter()
    for key, text in rows:
        x = a.encode(" " + text, add_special_tokens=False) if text else None
        xs, ys = (x.ids, b.encode(text)) if text else ([], [])
        xb = [bytes(alphabet[c] for c in t) for t in x.tokens] if text else []
        yb = [alignment.piece_bytes(b.id_to_piece(i)) for i in ys]
        if text and not b"".join(xb) == (" " + text).encode() == b"".join(yb):
            xs, ys, xb, yb = [], [], [], []
        ax, by = (np.cumsum([0, *map(len, t)]).tolist() for t in (xb, yb))
        links, j = [], 0
        for i in range(len(xs)):
            while j and by[j] > ax[i]:
                j -= 1
            while j < len(ys) and by[j] < ax[i + 1]:
                if by[j + 1] > ax[i]:
                    links.append((xs[i], ys[j]))
                j += 1
        ends = sorted(set(ax[1:]) & set(by[1:]))
        groups, m, n = [], 0, 0
        for e in ends:
            i, j = ax.index(e, m), by.index(e, n)
            groups.append(",".join(map(str, xs[m:i])) + "|" + ",".join(map(str, ys[n:j])))
            m, n = i, j
        done.append((key, xs, ys, links, ";".join(groups), len(ends)))
        holds.update(set(links))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    return Counter((key, len(xs), len(ys), n, len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if xs else "", g) for key, xs, ys, links, g, n in done)


def aligned(spark, rows, partitions):
    import public_tokenizers
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(frame(spark, rows).repartition(partitions), *paths, groups=True)


@pytest.mark.parametrize("partitions", [1, 5])
def test_alignment_against_whole_texts(spark, partitions):
    common.prepare(spark)
    rows = [*documents()[:120], *((10_000 + i, x) for i, x in enumerate(odd_texts()) if len(x or "") < 1000), (7, "twice"), (7, "twice"), (None, "no key")]
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in aligned(spark, rows, partitions).collect())
    assert got == brute_alignment(rows)
    assert sum(1 for r in got if r[1] == 0) > 2 and "op11_cross_tokenizer_alignment" in queries.QUERIES


def test_alignment_of_nothing_and_of_texts_without_tokens(spark):
    assert aligned(spark, [], 1).count() == 0
    assert [tuple(r) for r in aligned(spark, [(1, None), (2, "\u2581")], 2).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "", "") for i in (1, 2)]


def test_stretches_are_encoded_as_in_whole_texts():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        both = alignment.Both(f.read(), g.read())
    assert not [t for t in both.b_bytes if b" " in t.lstrip(b" ")]  # no piece goes across a cut
    rng = random.Random(5)
    bits = ["a", "B9", " ", " ", "  ", "\n", "\t", "é", "'s", ".", "!?", "<|endoftext|>", "日本", "\u3000", "\x1c", "0", "the", "<s>", "\u00a0", "\r\n", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        first, *rest = alignment._CUT.split(text)
        a, n_a, b, n_b = both.aligned([first, *(s[1:] for s in rest)])
        want_a, want_b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        if n_a.all():
            assert (a.tolist(), b.tolist()) == (want_a, want_b)
        else:
            assert b"".join(both.b_bytes[i] for i in want_b) != (" " + text).encode()
    words = ["plain", "", "né", "日本", "a b", "x\ty", "it's", "\u00ad", "end."] * 3
    ids, n = both.encode_a(words)
    assert both.fast and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [both.a.encode(" " + w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_runs_merge_to_the_same_counts(seed):
    rng = np.random.default_rng(seed)
    runs = [np.unique(rng.integers(0, 2000, 300) << 32 | rng.integers(0, 40, 300)) for _ in range(7)] + [np.empty(0, np.int64)]
    counts = [rng.integers(1, 9, len(r)) for r in runs]
    want = Counter()
    for r, c in zip(runs, counts, strict=True):
        want.update(dict(zip(r.tolist(), c.tolist(), strict=True)))
    got, back = {}, defaultdict(list)
    for pairs, n, places in alignment.merged([alignment.run_of(r, c) for r, c in zip(runs, counts, strict=True)]):
        assert not got or max(got) < pairs[0]
        got |= dict(zip(pairs.tolist(), n.tolist(), strict=True))
        for k, at in places:
            back[k] += pairs[at].tolist()
    assert got == dict(want) and all(back[k] == r.tolist() for k, r in enumerate(runs))
    assert alignment.radix(runs[0], 5).max() < 5
