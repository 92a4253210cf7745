"""Exact and near duplicates and passages, against brute force."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import exact_dedup, near_dedup, substring_dedup
from quarry.llm.queries import OP10_SQL, op1_minhash_near_dedup, op6_substring_dedup, op10_exact_dedup
from quarry.llm.words import shingle_sets, split_words, text_slices
from tests.oracle import connect, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def passages_brute(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), " ".join(kept))
    return out


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def family_texts(rng):
    """Copies mutated at many rates, short texts, a passage that all share, and loners."""
    rows, base, line = [], prose(rng, 160), prose(rng, 60)
    for k in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 12)):
            text[rng.randrange(len(text))] = f"m{k}x{rng.randrange(9999)}"
        rows.append(" ".join(text))
    rows += [" ".join(prose(rng, rng.randrange(5, 80)) + line) for _ in range(60)]
    rows += [" ".join(prose(rng, rng.randrange(0, 12), 6)) for _ in range(80)]
    rows += [None, "", "  \n", "one", "ONE", "one two three", "one\ttwo\x0bthree", " ".join(prose(rng, 9000)), "é ü " * 40]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_against_all_pairs(spark, docs_of, seed):
    rows = family_texts(random.Random(seed))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs_of(rows)).collect()}
    assert got == near_brute(rows)


def test_near_groups_with_small_sketches_and_blocks(spark, docs_of, monkeypatch):
    """Sketches that are cut, and groups of many blocks."""
    rows = family_texts(random.Random(5))
    original = near_dedup._in_blocks
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda *a: original(*a, block=16))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs_of(rows), k=48, k_long=120).collect()}
    assert got == {i: v[1] for i, v in near_brute(rows).items()}


def test_near_groups_of_odd_tables(spark, docs_of):
    assert near_dedup.near_groups(docs_of([])).count() == 0
    repeated = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, "")])
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(repeated).collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)], key=key)


def test_one_of_each_near_group_stays(spark, docs_of):
    rows = family_texts(random.Random(9))
    kept = near_dedup.keep_one_of_each(docs_of(rows, extra=False))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in near_brute(rows).items() if v[2]}


def test_near_copies_under_repeated_and_null_ids(spark, docs_of):
    """Each row goes by its own text, whatever else bears its id."""
    rng = random.Random(3)
    a, b, c, lone = (prose(rng, 40, 10**6) for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "changed"])
    a, b, c, lone, a1, b1, c1 = *map(" ".join, (a, b, c, lone)), near(a), near(b), near(c)
    rows = [(1, a), (2, b), (7, a1), (7, b1), (7, lone), (None, a1), (None, c), (None, c1), (None, lone + " x"), (None, None), (None, "")]
    want = [(1, a, 1, True), (2, b, 2, True), (7, a1, 1, False), (7, b1, 2, False), (7, lone, 7, True), (None, a1, 1, False)]
    want += [(None, c, None, True), (None, c1, None, False), (None, lone + " x", 7, False), (None, None, None, True), (None, "", None, True)]
    table = docs_of(rows, extra=False).coalesce(1)
    got = near_dedup.near_groups(table).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, m, k) for i, _, m, k in want), key=str)
    kept = near_dedup.keep_one_of_each(table).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((i, t) for i, t, _, k in want if k), key=str)


def test_near_groups_delete_texts_and_sketches_before_they_link(spark, docs_of, monkeypatch):
    """Pairs are judged on the sets alone, so neither the texts' copy nor the first sketches take disk meanwhile."""
    seen, original = [], near_dedup._link_lists

    def listing(scratch, *a):
        root = scratch.root.removeprefix("file://").removeprefix("file:")
        seen.append(sorted(name.split("-", 1)[1] for name in os.listdir(root)))
        return original(scratch, *a)

    monkeypatch.setattr(near_dedup, "_link_lists", listing)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " end"), (3, "quite another text than these two are")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs_of(rows, extra=False)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert seen == [["classes", "lists", "sets", "signatures"]]


def test_near_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op1_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == near_brute(rows)


def test_words_and_shingles_in_slices():
    rng = random.Random(4)
    texts = [None, "", " ", "x", "a\x0bb\x0cc\x1cd", "ÄÖ a\u00a0b"] + [" ".join(prose(rng, rng.randrange(30), 3)) for _ in range(50)]
    for a, b, data, offsets in text_slices(pa.array(texts), 64):
        words = split_words(data, offsets, lower=True)
        for k, s in enumerate(shingle_sets(words, 5)):
            assert len(s) == len(shingles(texts[a + k])) and (s[1:] > s[:-1]).all()
            spans = zip(words.start[words.first[k] : words.first[k + 1]], words.stop[words.first[k] : words.first[k + 1]])
            assert [bytes(data[x:y]).decode() for x, y in spans] == WORD.findall(texts[a + k] or "")


@pytest.mark.parametrize("crowd", [400, 1])
def test_passages_against_brute_force(spark, docs_of, crowd):
    rng = random.Random(7)
    rows = family_texts(rng)
    line = prose(rng, 45)  # shorter than a window, so only its surroundings can make a match
    rows += [(1000 + k, " ".join(prose(rng, rng.randrange(20)) + line + prose(rng, 20, 2))) for k in range(40)]
    rows += [(2000, " ".join(["a"] * 130)), (2001, " ".join(["a"] * 49)), (2002, " ".join(["a"] * 51)), (2003, " ".join(["b"] + ["a"] * 50 + ["c"]))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs_of(rows), crowd=crowd).collect()}
    assert got == passages_brute(rows)


def test_passages_of_odd_tables(spark, docs_of):
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (2, None), (9, text + " tail")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == [("2", 0, 0), ("5", 60, 0), ("5", 60, 0), ("9", 61, 60), ("None", 60, 60)]


@pytest.mark.parametrize("crowd", [400, 1])
def test_passages_of_repeated_rows_in_crowds(spark, docs_of, crowd):
    """Repeated rows and rows of null id among differently surrounded lines; each row is judged as if it stood once."""
    rng = random.Random(11)
    line = prose(rng, 70)
    rows = [(k, " ".join(prose(rng, rng.randrange(1, 20)) + line[rng.randrange(8) :] + prose(rng, 20))) for k in range(30)]
    null = 10**6  # null ids count as larger than all others
    rows.append((null, " ".join(prose(rng, 9) + line + prose(rng, 9))))
    want = passages_brute(rows)
    assert any(0 < r < n for n, r, _ in want.values())
    table = [(None if i == null else i, t) for i, t in rows for _ in range(3 if i % 4 == 0 else 1)]
    got = [(r["doc_id"], (r["n_words"], r["n_removed"], r["kept_text"])) for r in substring_dedup.remove_repeats(docs_of(table), crowd=crowd).collect()]
    assert sorted(got, key=str) == sorted(((i, want[null if i is None else i]) for i, _ in table), key=str)


def alternating(n, one, two):
    """One and two in the order of the Thue-Morse sequence, on which sums of powers cancel out."""
    return [(one, two)[bin(i).count("1") % 2] for i in range(n)]


def test_texts_built_to_collide(spark, docs_of):
    """Words, and sequences of words, that any polynomial hash with an odd base takes for equal."""
    a, b = ("".join(alternating(4096, *x)) for x in ("ab", "ba"))
    words = [[f"{w}{k}" if k % 7 else w for k in range(60)] for w in (a, b)]
    rows = [(n, " ".join(w)) for n, w in enumerate(words)]
    rows += [(n + 2, " ".join(alternating(4096, *x))) for n, x in enumerate((("x", "y"), ("y", "x")))]
    rows += [(4, " ".join(words[1][:50] + ["tail"])), (5, a), (6, b)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs_of(rows)).collect()}
    assert got == near_brute(rows) and got[1][1] == 1 and got[6][1] == 6
    for crowd in (400, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs_of(rows), crowd=crowd).collect()}
        assert got == passages_brute(rows) and got[1][1] == 0 and got[4][1] == 50


def test_whole_copies_in_a_crowd(spark, docs_of):
    """A line that many documents surround differently, each of them twice: the later copy goes as a whole."""
    rng = random.Random(12)
    line = prose(rng, 55)
    texts = [" ".join(prose(rng, rng.randrange(20, 30), 10**6) + line + prose(rng, 30, 10**6)) for _ in range(12)]
    rows = list(enumerate([*texts, *texts]))
    for crowd in (400, 3):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs_of(rows), crowd=crowd).collect()}
        assert got == passages_brute(rows) and all(got[i][2] == "" for i in range(12, 24))


def test_near_links_of_unlike_texts_under_one_id(spark, docs_of):
    """Two texts of one id and one size: each keeps its own links."""
    rng = random.Random(13)
    a, b = (prose(rng, 30, 10**6) for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b + ["z"])), (3, " ".join(a + ["y"]))]
    got = near_dedup.near_groups(docs_of(rows, extra=False).coalesce(1)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_columns_with_dots(spark):
    """Near groups and passages read id and text columns whose names hold dots."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 0), (2, text + " more", 0)], "`a.id` long, `b.text` string, o long")
    near = near_dedup.near_groups(df, "a.id", "b.text").collect()
    assert [(r["component_id"], r["kept"]) for r in sorted(near, key=lambda r: r["a.id"])] == [(1, True), (1, False)]
    left = substring_dedup.remove_repeats(df, "a.id", "b.text").collect()
    assert {r["a.id"]: r["n_removed"] for r in left} == {1: 0, 2: 60}


def test_passage_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, r, hashlib.sha256(t.encode()).hexdigest()) for i, (n, r, t) in passages_brute(rows).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op6_substring_dedup(spark, sf_dir).collect()} == want


def test_automaton_names_first_owners():
    rng = random.Random(2)
    strings = [([rng.choice("ab") for _ in range(rng.randrange(3, 30))], o) for o in range(40)]
    sam = substring_dedup.SuffixAutomaton()
    for s, o in strings:
        sam.add(s, o)
    sam.settle()
    for s, _ in strings + [(list("abcab"), 0)]:
        want = []
        for i in range(len(s) - 2):
            want.append(min((o for t, o in strings if any(t[j : j + 3] == s[i : i + 3] for j in range(len(t)))), default=substring_dedup._LAST))
        assert sam.first_owners(s, 3) == want


def test_exact_groups(spark, docs_of):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a\x0b\x0c\nb"), (4, "a\u00a0b"), (7, None), (6, ""), (8, " "), (2, "A b"), (3, "a b"), (None, "a b")]
    got = defaultdict(set)
    for r in exact_dedup.exact_groups(docs_of(rows)).collect():
        got[r["doc_id"]].add((r["keep_id"], r["group_size"], r["text_sha256"] == hashlib.sha256(b"a b").hexdigest()))
    assert got[5] == got[9] == got[None] == got[3] == {(3, 5, True)}
    assert got[7] == got[6] == {(6, 2, False)} and got[8] == {(8, 1, False)}
    kept = exact_dedup.drop_exact_copies(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6, 8] and kept.columns == docs_of([]).columns
    assert exact_dedup.exact_groups(docs_of([])).count() == 0


@pytest.mark.parametrize("runs, fan_in", [(1, 2), (16, 2), (64, 8), (5, 3)])
def test_exact_groups_do_not_depend_on_the_tree(spark, sf_dir, runs, fan_in):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same_rows(exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in), connect(sf_dir), OP10_SQL)


def test_exact_query(spark, sf_dir):
    same_rows(op10_exact_dedup(spark, sf_dir), connect(sf_dir), OP10_SQL)
