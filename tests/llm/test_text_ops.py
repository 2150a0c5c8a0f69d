"""Line dedup, decontamination, near duplicates and packing against plain versions."""

import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import near_dup
from pointweave.llm._text import BLANK_BYTES, shingles, words
from pointweave.llm.components import connected_components, merged_components
from pointweave.llm.decontaminate import MAX_TABLE_WORDS, WuManber, find_contamination
from pointweave.llm.line_dedup import drop_repeated_lines
from pointweave.llm.near_dup import near_duplicates
from pointweave.llm.packing import Tokens, first_fit_decreasing, pack_documents
from pointweave.llm.queries import byte_bpe_path

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix Große Äpfel and ñandú".split()
SCHEMA = "doc_id long, text string, lang string, `odd name` int, n_lines string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", k, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(seed, n, low=1, high=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(low, high))) for _ in range(n)]


# -- line dedup -----------------------------------------------------------------


def plain_line_dedup(rows, min_docs):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    gone = {k for k, v in docs.items() if k and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_line_dedup(spark, max_broadcast):
    rng = random.Random(1)
    lines = ["Shared", " shared\t", "ÄB", "äb", "", " ", "one", "Two", "three\r", "x" * 5000]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "\n\n", "shared"]
    ids = [*range(60), 60, 61, 62, None]
    ids[5] = ids[6] = 7  # three rows of one document
    df = frame(spark, texts, ids)
    out = drop_repeated_lines(df, min_docs=12, max_broadcast=max_broadcast)
    assert out.columns == ["doc_id", "text", "lang", "odd name", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == plain_line_dedup(list(zip(ids, texts, strict=True)), 12)
    assert drop_repeated_lines(df.limit(0), max_broadcast=max_broadcast).count() == 0
    clash = df.withColumnsRenamed({"lang": "n_lines", "odd name": "id"})
    assert drop_repeated_lines(clash, max_broadcast=max_broadcast).columns == ["doc_id", "text", "id", "n_lines", "n_dropped"]
    with pytest.raises(ValueError):
        drop_repeated_lines(df, min_docs=0)


# -- decontamination --------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, size):
    wins = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            wins[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, own = plain_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(own)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tables", [1, 3])
def test_decontamination(spark, monkeypatch, tables):
    items = [(k, t) for k, t in enumerate(sentences(2, 12, 1, 30))]
    items += [(3, "second text of item three with quite a few words in it all"), (None, "no id at all here"), (40, None), (41, " .,; ")]
    docs = sentences(3, 40, 1, 80)
    rng = random.Random(4)
    for k in range(0, 40, 3):
        docs[k] = docs[k] + "!" + (rng.choice(items)[1] or "").upper() + " " + docs[k]
    docs += [None, "", "...", docs[0], docs[0]]
    if tables > 1:
        monkeypatch.setattr("pointweave.llm.decontaminate.MAX_TABLE_WORDS", 80)
    df = frame(spark, docs).withColumnRenamed("n_lines", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(df, bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in out.collect()), key=str)
    assert got == plain_contamination(list(enumerate(docs)), items, 13)
    assert any(r[4] for r in got) and MAX_TABLE_WORDS > 0
    empty = find_contamination(df, bench.limit(0)).agg(F.sum("n_hit"), F.count_if("contaminated")).first()
    assert tuple(empty) == (0, 0)
    assert find_contamination(df.limit(0), bench).count() == 0


def test_wu_manber_repeats_and_overlaps():
    table = WuManber([("a", [b"x"] * 5), ("b", [b"x", b"y"]), ("c", [b"z"])], 3)
    hits, items = bytearray(8), set()
    table.search([b"x", b"x", b"x", b"x", b"y", b"q", b"z", b"x"], hits, items)
    assert list(hits) == [1, 1, 1, 1, 1, 0, 1, 0] and items == {"a", "b", "c"}


# -- near duplicates ----------------------------------------------------------------


def plain_shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def plain_components(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if (both and 100 * both >= 75 * len(sets[a] | sets[b])) or rows[a][0] == rows[b][0]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return sorted(
        (
            (i, len(sets[k]), least[find(k)] if i is not None else None, i is None or i == least[find(k)])
            for k, (i, _) in enumerate(rows)
        ),
        key=str,
    )


def variants(seed, text, n, edits):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = text.split(" ")
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 10**6))
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    base = sentences(5, 6, 80, 150)
    texts = sentences(6, 40, 1, 60)
    for k, t in enumerate(base):
        texts += variants(k, t, 14, 5) + [t, t.upper()]
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]
    random.Random(7).shuffle(texts)
    ids = [10 * k for k in range(len(texts))]
    ids[3] = None
    out = near_duplicates(frame(spark, texts, ids))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    want = plain_components(list(zip(ids, texts, strict=True)))
    assert got == want
    assert near_duplicates(frame(spark, texts, ids).limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    """More near copies than a window holds, and look-alikes below the threshold, lose no link."""
    base = sentences(8, 1, 120, 120)[0]
    texts = variants(9, base, 150, 6) + variants(10, base, 60, 30)
    out = near_duplicates(frame(spark, texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == plain_components(list(enumerate(texts)))


def test_link_behind_many_look_alikes(spark):
    """Links that are not among a node's best-estimated candidates: all pairs of a template are just below."""
    rng = random.Random(12)
    word = lambda: "w" + str(rng.randint(0, 10**9))
    template = [word() for _ in range(304)]
    texts = []
    for k in range(240):
        own = [word() for _ in range(53)]
        if k % 6 == 1:  # some words in common with the one before: just above
            own[:8] = last[:8]
        texts.append(" ".join(template + own))
        last = own
    random.Random(13).shuffle(texts)
    out = near_duplicates(frame(spark, texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    want = plain_components(list(enumerate(texts)))
    assert sum(not r[3] for r in want) == 40
    assert got == want


def in_one_region(monkeypatch):
    """All documents get the same minhashes in the first tree, which orders them by id, and others elsewhere."""
    signatures, width = near_dup._signatures, 4 * near_dup.DEPTH
    other = [F.unhex(F.sha2(F.concat_ws(" ", "id", F.lit(k)), 256)) for k in range(near_dup.TREES)]
    mins = F.substring(F.concat(F.lit(bytes(width)), *other), 1, width * near_dup.TREES)
    monkeypatch.setattr(near_dup, "_signatures", lambda *a: signatures(*a).withColumn("mins", mins))


@pytest.mark.parametrize("block", [8192, 300])
def test_region_of_more_than_the_window(spark, monkeypatch, block):
    in_one_region(monkeypatch)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}" for k in range(2300)]
    texts[1] = texts[0] + " x"  # a link for the first pass
    texts[2200:2203] = [t + " x" for t in texts[20:23]]
    out = near_duplicates(frame(spark, texts)).filter("NOT kept").collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 0), (2200, 20), (2201, 21), (2202, 22)}


def test_first_pass_without_a_link(spark, monkeypatch):
    in_one_region(monkeypatch)
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}" for k in range(40)]
    texts[35] = texts[2] + " x"
    out = near_duplicates(frame(spark, texts)).filter("NOT kept").collect()
    assert [(r.doc_id, r.component_id) for r in out] == [(35, 2)]


@pytest.mark.parametrize("blocks", [None, 40])
def test_two_documents_among_look_alikes(spark, monkeypatch, blocks):
    """A and B just above the threshold, each with many look-alikes just below it."""
    if blocks:
        monkeypatch.setattr(near_dup, "CONFIRM_NODES", blocks)
        monkeypatch.setattr(near_dup, "BLOCK", 10 * blocks)
    rng = random.Random(21)
    word = lambda: "w" + str(rng.randint(0, 10**9))
    both = [word() for _ in range(515)]  # 511 shingles
    a, b = both + [word() for _ in range(85)], both + [word() for _ in range(85)]
    assert plain_components([(0, " ".join(a)), (1, " ".join(b))])[1][2] == 0
    texts = [" ".join(a), " ".join(b)]
    for one in (a, b):
        for _ in range(400):
            texts.append(" ".join(one[:506] + [word() for _ in range(94)]))
    # look-alikes share at most 502 of 690 shingles with anything
    out = near_duplicates(frame(spark, texts)).filter("NOT kept").collect()
    assert [(r.doc_id, r.component_id) for r in out] == [(1, 0)]


def test_shingle_hashes_agree_with_sets():
    texts = ["a b  c\td e\nF", "A B C D E f", None, "", "x", "x y", "é " * 9, "w " * 400_000]
    w, at = words(pa.array(texts), BLANK_BYTES)
    sizes = [len(shingles(w[at[k] : at[k + 1]], 5)) for k in range(len(texts))]
    assert sizes == [len(plain_shingles(t)) for t in texts]
    assert list(shingles(w[at[0] : at[1]], 5)) == list(shingles(w[at[1] : at[2]], 5))


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (600, 100, 100))
    x, y = (near_dup.sketch_of(near_dup.minhashes(np.concatenate([both, o]))) for o in (a, b))
    assert abs(near_dup.estimates(x.view("<u8"), y.view("<u8")) - 0.75) < 0.12


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    out = connected_components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {(r.node, r.root) for r in out} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}
    empty = spark.createDataFrame([], "a long, b long")
    assert connected_components(empty).count() == 0
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    frame_of = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = [connected_components(frame_of(links[:90]))]
    for more in (links[90:91], [], links[91:]):
        parts.append(merged_components(parts[-1], frame_of(more)))
    for k, n in ((1, 91), (2, 91), (3, 240)):
        used = frame_of(links[:n])
        assert {(r.node, r.root) for r in parts[k].collect()} == {(r.node, r.root) for r in connected_components(used).collect()}
    assert {(r.node, r.root) for r in merged_components(connected_components(empty), frame_of([(2, 1)])).collect()} == {(1, 1), (2, 1)}


# -- packing --------------------------------------------------------------------------


def reference_ids(texts, path=None):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path or byte_bpe_path())
    return [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_are_those_of_the_library():
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "'t", "12", "<|endoftext|>", "\u00a0", "\u3000", "中", "!", "?!", "\r\n", "\x1c", "\x85", " the", "'", "x'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "\n\n", "x" * 3000]
    tokens = Tokens(byte_bpe_path())
    assert tokens.model is not None
    flat, at = tokens.ids(pa.array(texts))
    assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == reference_ids(texts)
    flat, at = tokens.ids(pa.array(["a<|endoftext|>b", "<|endoftext", "|>"]))
    assert flat[: at[1]].tolist() == [64, 50256, 65]
    assert len(tokens.ids(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("change", ["normalizer", "prefix", "merges", "word ends"])
def test_other_files_go_through_the_library(tmp_path, change):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if change != "word ends":
        spec = json.loads(open(byte_bpe_path(), encoding="utf-8").read())
        if change == "normalizer":
            spec["normalizer"] = {"type": "Lowercase"}
        elif change == "prefix":
            spec["pre_tokenizer"]["add_prefix_space"] = True
        else:
            spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
        path = str(tmp_path / "file.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(spec, file)
    texts = [*sentences(3, 40), "The  the\tTHE <|endoftext|> x", None, ""]
    tokens = Tokens(path)
    assert tokens.model is None
    flat, at = tokens.ids(pa.array(texts))
    assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == reference_ids(texts, path)


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = first_fit_decreasing(lengths, 100)
    free: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):  # the plain rule
        at = next((b for b, f in enumerate(free) if f >= lengths[k]), None)
        if at is None:
            at = len(free)
            free.append(100)
        assert bins[k] == at and offsets[k] == 100 - free[at]
        free[at] -= lengths[k]
    assert len(first_fit_decreasing(np.zeros(0, int), 100)[0]) == 0


def test_packing_round_trip(spark):
    texts = sentences(11, 60, 1, 200) + [None, "", "y " * 3000, "same", "same"]
    df = frame(spark, texts)
    out = pack_documents(df, byte_bpe_path(), capacity=256, group_pieces=40).collect()
    ids = [x + [0] for x in reference_ids(texts)]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, own))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in by_doc.items()} == dict(enumerate(ids))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    digest = pack_documents(df, byte_bpe_path(), digest=True).collect()
    for r in digest:
        own = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own)
    assert pack_documents(df.limit(0), byte_bpe_path()).count() == 0
    repeated = frame(spark, ["x y z", "x y z", None, "x y z"], [1, 1, None, None])
    out = pack_documents(repeated, byte_bpe_path()).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == [("1", 4), ("1", 4), ("None", 1), ("None", 4)]
    clash = df.withColumnsRenamed({"lang": "start", "odd name": "sequence_id"})
    assert pack_documents(clash, byte_bpe_path()).count() == pack_documents(df, byte_bpe_path()).count()
