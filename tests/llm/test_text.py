"""Tokens, secrets, toxicity, mixing and HTML, against brute force, round trips or held-out accuracy."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, html_blocks, html_extract, html_training, mixing, secrets, toxicity
from quarry.llm.queries import op2_secret_scan, op3_toxicity, op7_source_mix, op8_html_extract, op9_byte_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_for(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_hash_is_minimal_and_perfect(codec):
    assert sorted(codec.table.at) == list(range(len(codec.tokens)))
    assert all(codec.tokens[codec.table.index(t)] == t for t in codec.tokens[::7])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_encoding_is_the_librarys(codec, library, texts):
    ids, cuts = bpe.encode_texts(bpe._Memo(codec), texts)
    assert [list(ids[a:b]) for a, b in zip(cuts, cuts[1:])] == [library.encode_ordinary(t) for t in texts]


def test_long_pre_tokens(codec, library):
    for text in ("a" * 20_000, "xy" * 5_000, "\u4e2d\u6587" * 3_000, " " * 10_000 + "x"):
        assert [i for w in codec.split(text) for i in codec.piece(w.encode())] == library.encode_ordinary(text)


def test_memo_turns(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_LIMIT", 3)
    texts = ["one two three four five six seven", "one two zzzqx", "seven six"] * 3
    ids, cuts = bpe.encode_texts(bpe._Memo(codec), texts)
    assert [list(ids[a:b]) for a, b in zip(cuts, cuts[1:])] == [library.encode_ordinary(t) for t in texts]


def test_long_pre_tokens_are_not_remembered(codec, library):
    memo, text = bpe._Memo(codec), "short " + " ".join("x" * n + str(n) for n in range(28, 400))
    ids, _ = bpe.encode_texts(memo, [text])
    assert list(ids) == library.encode_ordinary(text) and max(map(len, memo)) <= bpe.MEMO_LENGTH


def test_memo_is_bounded_within_a_text(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_LIMIT", 100)
    memo, text = bpe._Memo(codec), " ".join(a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnprstvwxz")
    ids, _ = bpe.encode_texts(memo, [text])
    assert list(ids) == library.encode_ordinary(text)
    assert len(memo) + len(memo.old) <= 200


def test_workers_given_other_work_hold_no_memo(spark, docs_of, codec):
    def held(batches):
        import gc

        from quarry.llm import bpe

        list(batches)
        gc.collect()
        n = sum(isinstance(x, (bpe._Memo, bpe.BytePairCodec)) for x in gc.get_objects())
        yield bpe.pa.RecordBatch.from_pydict({"n": bpe.pa.array([n], bpe.pa.int64())})

    assert bpe.with_tokens(docs_of([(i, f"text {i}") for i in range(50)]), codec).filter("size(token_ids) > 0").count() == 50
    assert {r["n"] for r in spark.range(50).mapInArrow(held, "n long").collect()} == {0}


def test_tokens_of_odd_tables(spark, docs_of, codec, library):
    rows = [(1, None), (2, ""), (3, "é\x00 <|endoftext|>"), (3, "é\x00 <|endoftext|>"), (4, "long " * 60_000)]
    got = bpe.with_tokens(docs_of(rows), codec)
    assert got.columns.count("token_ids") == 1 and "kept" in got.columns
    for r in got.collect():
        assert r["token_ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    again = bpe.decode(got.drop("decoded"), codec)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again.collect())
    assert bpe.with_tokens(docs_of([]), codec).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [50_000])], "k int, token_ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(nulls, codec).orderBy("k").collect()] == [b"", codec.tokens[codec.ids.index(50_000)]]
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([([60_000],)], "token_ids array<int>"), codec).collect()


def test_token_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- secrets --------------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_brute(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


PIECES = ["password", "PASSWD", "api_key", "ApiKey", "token", "secret", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "=", ":", " ", '"', "'", "\n\n", "x", "ſecret", "toKen", "user=bob", "https://h.example/x", "abc123", "k"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_certain_findings(text):
    certain, every = secrets.scan(text)
    assert certain == base_brute(text)
    assert set(certain) <= set(every)
    keys = [(p[1], secrets.KINDS.index(p[0])) for p in every]
    assert keys == sorted(keys)


def test_parts_are_reported_only_together():
    alone = "see https://host.example/path for more"
    assert secrets.scan(alone) == ([], [])
    together = "user=bob pwd=hunter22x at https://host.example/path"
    assert {k for k, _, _ in secrets.scan(together)[1]} == {"identifier", "secret", "endpoint"}
    assert secrets.scan("user=bob\n\npwd=hunter22x") == ([], [])  # not in one scope
    assert secrets.scan("user=bob" + " word" * 60 + " pwd=hunter22x") == ([], [])  # out of reach
    certain, every = secrets.scan("password = hunter22x host=db.internal")
    assert [p[0] for p in certain] == ["assign"] and [p[0] for p in every] == ["assign", "endpoint"]


def linked_brute(text, reach):
    """Each weak candidate against each other part, pair by pair."""
    certain, weak = base_brute(text), secrets._weak(text)
    scope = lambda p: len([m for m in re.finditer(r"\n[ \t\r]*\n", text) if m.start() <= p[1]])
    pairs = {("identifier", "secret"), ("identifier", "assign"), ("identifier", "hex"), ("endpoint", "secret"), ("endpoint", "assign"), ("secret", "access")}
    found = set()
    for p in weak:
        for q in [*certain, *weak]:
            gap = max(p[1], q[1]) - min(p[2], q[2])
            if ((p[0], q[0]) in pairs or (q[0], p[0]) in pairs) and scope(p) == scope(q) and 0 <= gap <= reach:
                found.add(p)
    return sorted([*certain, *{p for p in found if not any(a < p[2] and p[1] < b for _, a, b in certain)}], key=lambda p: (p[1], secrets.KINDS.index(p[0]), p[2]))


MORE = [*PIECES, "pwd=hunter22", "host: db1.example", "10.0.0.1:8080 ", "\nkey=abcdefgh ", "aB3" * 8, "\n \r\n", "word word ", "account_id=77123 "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(MORE), max_size=25).map("".join), st.integers(0, 60))
def test_linked_findings_against_all_pairs(text, reach):
    assert secrets.scan(text, reach)[1] == linked_brute(text, reach)


def test_links_do_not_chain():
    urls = " ".join(f"some words and https://site{k}.example/page" for k in range(200))
    assert [p[0] for p in secrets.scan("token=abcdefg at https://h.example/x " + "word " * 60 + urls)[1]] == ["assign", "endpoint"]
    assert [p[0] for p in secrets.scan("fixed in 0123456789abcdef0123456789abcdef, see https://git.example/log")[1]] == ["hex"]
    assert secrets.scan("https://video.example/AbCdEfGhIjKlMnOpQrSt1234") == ([], [])  # one part twice is no pair


def test_many_findings_in_one_text_take_linear_time():
    text = "token=abcdefg user=bob pwd=hunter22x https://h.example/x\n" * 17_000  # 1 MB
    start = time.perf_counter()
    certain, every = secrets.scan(text)
    assert len(certain) == 17_000 and len(every) == 68_000 and time.perf_counter() - start < 10


def test_every_name_word_reaches_the_path():
    many = [f"u{c}" for c in "abcdefghijkl"]
    page = f'<div class="{" ".join(many)} sidebar" id="x" role="complementary"><p>text</p></div>'
    assert html_blocks.leaf_blocks(page)[0].path == ("div", *["." + w for w in many], ".sidebar", ".x", ".complementary", "p")


def test_parts_of_prefixed_names():
    def parts(text):
        return [(k, text[a:b]) for k, a, b in secrets.scan(text)[1]]

    env = "DB_USER=svcadmin\nDB_PASS=hunter22\nDB_HOST=db.example.com"
    assert parts(env) == [("identifier", "USER=svcadmin"), ("secret", "PASS=hunter22"), ("endpoint", "HOST=db.example.com")]
    assert parts("db_pwd: abcdef99 user: bob") == [("secret", "pwd: abcdef99"), ("identifier", "user: bob")]
    assert parts("client_key=abcdefgh account_id=12345") == [("secret", "key=abcdefgh"), ("identifier", "account_id=12345")]
    assert parts('{"dbUser": "bob", "dbPass": "hunter22"}') == [("identifier", 'User": "bob'), ("secret", 'Pass": "hunter22')]
    aws = "aws_access_key_id=abcd1234\naws_secret_access_key=wxyz6789"
    assert parts(aws) == [("identifier", "access_key_id=abcd1234"), ("secret", "secret_access_key=wxyz6789")]
    for alone in ("monkey=bananas user: bob", "my_access_key=abcdefgh", "accessKey=abcdefgh", "aws_secret_access_key=wxyz6789"):
        assert parts(alone) == []


def test_secrets_of_odd_tables(spark, docs_of):
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs_of([(1, None), (2, ""), (3, "é" * 50_000 + " token=abcdef")])).collect()}
    assert got[1]["findings"] == got[2]["findings"] == [] and got[3]["findings"][0]["start"] == 50_001
    assert secrets.find_secrets(docs_of([])).count() == 0


def test_secret_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_secret_scan(spark, sf_dir).collect():
        want = base_brute(texts[r["doc_id"]])
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.CERTAIN)
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


# --- toxicity -------------------------------------------------------------------------------------


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    s, y = rng.random(200), (rng.random(200) < 0.5).astype(float)
    knots, values = toxicity.isotonic(s, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert np.isclose((values * np.array([1])).min(), values[0]) and 0 <= values.min() <= values.max() <= 1
    perfect = toxicity.isotonic(np.arange(10.0), (np.arange(10) > 4).astype(float))[1]
    assert perfect[0] == 0 and perfect[-1] == 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    p = toxicity.BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


def toxic_rows(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}a{rng.choice('lmnr')}o" for _ in range(rng.randrange(10, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["blarg", "zonk", "you idiot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = toxicity.train(docs, table)
    scored = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model, keep=["doc_id"]).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scored[i] >= 0.5) == (i % 5 == 0) for i in held) and all(0 <= s <= 1 for s in scored.values())
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scored.items() if s < 0.5}


def test_held_out_labels_do_not_matter(spark, docs_of):
    rows, labels = toxic_rows(200)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    texts = [t for _, t in rows]
    one, two = (toxicity.train(docs_of(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert (one.score(texts) == two.score(texts)).all()


def test_toxicity_of_odd_tables(spark, docs_of):
    rows, labels = toxic_rows(100)
    schema = "doc_id long, quality int, toxic int"
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, schema))
    got = toxicity.with_score(docs_of([(1, None), (2, ""), (3, "x" * 100_000)]), model).collect()
    assert len(got) == 3 and got[0]["score"] == got[1]["score"]
    assert toxicity.with_score(docs_of([]), model).count() == 0
    none = toxicity.train(docs_of(rows), spark.createDataFrame([], schema))
    assert toxicity.with_score(docs_of(rows), none).filter("score = 0").count() == 100
    assert toxicity.train(docs_of([]), spark.createDataFrame(labels, schema)).trees is None


def test_features_against_a_plain_count():
    """Fast paths of the features against the patterns that they stand for."""
    rng = random.Random(3)
    pieces = ["you", "idiot", "1d10t", "i.d.i.o.t", "ABC", "aABC", "ABC1", "_ABC", "AB", " ", " ", ".", "..", "!", "x@y", "é", "ß1", "m0r0n", "_", "-", "TU"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        p = toxicity.parse(text)
        found = re.findall(r"[^\W\d_]+(?:[0134578@$!*._-]+[^\W\d_]+)+", text)
        assert p.undone == [d.lower().translate(toxicity.LOOK_ALIKE) for d in found]
        n = max(1, p.length)
        capitals = sum("A" <= c <= "Z" for c in text)
        assert p.plain[0] == len(found) / n and p.plain[2] == (len(re.findall(r"\b[A-Z]{3,}\b", text)) / n if capitals > 2 else 0)


@pytest.mark.parametrize("text", ["x" * 1_000_000 + ". y", "." * 1_000_000, "A" * 1_000_000 + "1", "a." * 500_000, "_" * 1_000_000 + "a"])
def test_features_of_long_words_take_linear_time(text):
    start = time.perf_counter()
    toxicity.featurise(toxicity.parse(text), toxicity.Lexicon({"a": 1.0}, {}))
    assert time.perf_counter() - start < 5


def test_fit_takes_one_text_of_bounded_length_an_id(spark, docs_of):
    rows, labels = toxic_rows(100)
    schema = "doc_id long, quality int, toxic int"
    table = spark.createDataFrame(labels, schema)
    plain = toxicity.train(docs_of(rows), table)
    more = [(i, "zzzz " + t) for i, t in rows for _ in range(20)] + [(10**6, None)]
    assert toxicity.train(docs_of(rows + more), table).lexicon.words == plain.lexicon.words
    assert toxicity.train(docs_of(rows), table, longest=3).trees is None
    nulls = toxicity.train(docs_of([(i, None) for i, _ in rows]), table)
    assert 0 <= nulls.score([None])[0] <= 1


def test_toxicity_query_on_held_out_labels(spark):
    """Precision and recall of the query's predictions where labels were not fitted on."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["toxic"] is not None}
    got = [r for r in op3_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] and labels[r["doc_id"]] for r in got)
    assert right >= 0.97 * sum(r["predicted"] for r in got) and right >= 0.9 * sum(labels[r["doc_id"]] for r in got)
    toxic, clean = ([r["score"] for r in got if labels[r["doc_id"]] == v] for v in (1, 0))
    above = np.searchsorted(np.sort(clean), toxic, "left").sum() / (len(toxic) * len(clean))
    assert above > 0.95  # a toxic text scores over a clean one


def test_toxicity_query(spark, sf_dir):
    got = op3_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)


# --- mixing ---------------------------------------------------------------------------------------


def targets_brute(sizes):
    """Targets stop at twice a source's size; the excess goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        full |= over


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    p = mixing.Permutation(n, 12345 + n)
    out = p.of(np.arange(n))
    assert sorted(out) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.floats(0, 2), st.integers(1, 100))
def test_plans_take_the_target(size, share, block):
    blocks = -(-size // block)
    taken = 0
    for turn, whole, rest in mixing.slot_plan(size, size * share, block, 3, "s"):
        p = mixing.Permutation(blocks, mixing._key(3, "s", turn))
        assert whole <= blocks and (not rest or whole < blocks)
        for j, b in enumerate(p.of(np.arange(min(blocks, whole + (rest > 0))))):
            have = min(block, size - b * block)
            taken += have if j < whole else min(rest, have)
    assert taken == round(size * share)


def mix_rows():
    rng = random.Random(8)
    sources = ["b"] * 40 + ["a"] * 10 + ["c"] * 5 + [None] * 5 + ["huge"] * 30
    return [(i, None if i % 17 == 0 else " ".join(["w"] * rng.randrange(0, 300)), s) for i, s in enumerate(sources)]


def test_mix_meets_targets(spark, docs_of):
    rows = mix_rows() + [(3, "twice the id", "b"), (3, "twice the id", "b"), (None, "no id here", "a")]
    got = mixing.mixture(docs_of(rows)).collect()
    sizes, taken = {}, {}
    ids = {}
    for i, t, s in rows:
        ids.setdefault(i, set()).add(s)
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_brute(sizes)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    for r in got:
        (s,) = ids[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mixture(docs_of(rows).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def words_of_slots(slots, rows, block):
    """Words that each row gives, by id: slots are counted word by word over the sources' streams."""
    streams = {}
    for i, t, s in sorted(rows, key=lambda r: r[0]):
        streams.setdefault(s, []).extend([i] * len(WORD.findall(t or "")))
    taken = {i: 0 for i, _, _ in rows}
    for r in slots:
        for i in streams[r["source"]][r["blk"] * block : r["blk"] * block + r["words"]]:
            taken[i] += 1
    return taken


@pytest.mark.parametrize("block, shard_slots", [(16, 8), (5, 1000), (64, 1)])
def test_shards_draw_their_sources(spark, docs_of, block, shard_slots):
    """Every slot of every shard is filled once, from blocks taken once a pass, and rows give what the slots name."""
    rows = mix_rows()
    got = mixing.mix(docs_of(rows), block=block, shard_slots=shard_slots)
    slots, done = got.slots.collect(), got.rows.collect()
    shards = {}
    for r in slots:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(len(shards))) and len(shards) == -(-len(slots) // shard_slots)
    for k, mine in shards.items():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine))) and (len(mine) == shard_slots or k == len(shards) - 1)
    assert len({(r["source"], r["turn"], r["blk"]) for r in slots}) == len(slots)
    assert {r["_id"]: r["taken"] for r in done} == words_of_slots(slots, rows, block)
    # each shard's counts are what it draws alone
    names = sorted({r["source"] for r in slots}, key=lambda s: (s is None, s or ""))
    totals = np.array([sum(r["source"] == s for r in slots) for s in names])
    for k, mine in shards.items():
        first, counts = mixing.shard_counts(totals, k, shard_slots, 7)
        assert counts.tolist() == [sum(r["source"] == s for r in mine) for s in names] and (first + counts <= totals).all()
    # the shards of a row are those that hold words of it
    held = {}
    for r in mixing.mixed_blocks(docs_of(rows), block=block, shard_slots=shard_slots).collect():
        held.setdefault(r["doc_id"], set()).add(r["shard"])
    assert {r["_id"]: set(r["shards"]) for r in done} == {i: held.get(i, set()) for i, _, _ in rows}


def test_draws_are_multinomial():
    """Counts of a shard over many seeds have the mean and the spread of draws without replacement."""
    totals = np.array([600, 300, 90, 10])
    draws = np.array([mixing.shard_counts(totals, 3, 100, seed)[1] for seed in range(2000)])
    p = totals / 1000
    assert (draws.sum(axis=1) == 100).all() and np.allclose(draws.mean(axis=0), 100 * p, atol=0.5)
    assert np.allclose(draws.var(axis=0), 100 * p * (1 - p) * 900 / 999, rtol=0.15)
    huge = np.array([6 * 10**11, 3 * 10**11, 10**9, 5])
    first, counts = mixing.shard_counts(huge, 7, 10**7, 3)
    assert counts.sum() == 10**7 and abs(counts[0] / 10**7 - huge[0] / huge.sum()) < 0.01 and (first + counts <= huge).all()


def test_mixed_documents_hold_the_words_taken(spark, docs_of):
    rows = mix_rows()
    docs = docs_of(rows, extra=False)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {i: n for i, n in taken.items() if n}


def test_mix_of_odd_tables(spark, docs_of):
    assert mixing.mixture(docs_of([])).count() == 0
    assert [r["taken"] for r in mixing.mixture(docs_of([(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    assert mixing.mixture(docs_of([(1, "a b c d", "x")])).first()["taken"] == 6


def test_mix_query(spark, sf_dir):
    """Targets, and the words taken of each row, against the documents and the slots, counted anew."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    sizes = {}
    for i, r in docs.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    want = targets_brute(sizes)
    taken = words_of_slots(mixing.mix(table).slots.collect(), [(i, r["text"], r["source"]) for i, r in docs.items()], 64)
    got, total = op7_source_mix(spark, sf_dir).collect(), dict.fromkeys(sizes, 0)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"], r["taken"]) == (size[r["doc_id"]], sizes[s], taken[r["doc_id"]]) and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        total[s] += r["taken"]
    assert len(got) == len(docs) and all(abs(total[s] - want[s]) <= 1 for s in total)


# --- HTML -----------------------------------------------------------------------------------------


def test_blocks():
    page = '<!doctype html><title>no</title><!-- <p>no --><p>One&amp;two <b>bo</b>ld<p>x<br>y&nbsp; z<ul class="a b"><li><a href=x>l1</a><li>l2</ul><script>if (a<b) "</p>"</SCRIPT>tail'
    got = html_blocks.leaf_blocks(page)
    assert [b.text for b in got] == ["One&two bold", "x", "y z", "l1", "l2", "tail"]
    assert got[3].path == ("ul", ".a", ".b", "li") and got[3].linked == 1 and got[0].path == ("p",)
    for odd in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "a < b > c", "<p attr='>'>q"):
        html_blocks.leaf_blocks(odd)
    assert [b.text for b in html_blocks.leaf_blocks("<p attr='>'>q")] == ["q"]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p>one two<!-->three</p><p>four five</p>", ["one twothree", "four five"]), ("<p>a<!--->b</p><p>c", ["ab", "c"]), ("<p>a<!--x--!>b</p><p>c", ["ab", "c"]),
        ("<p>a<!-- x -->b</p><p>c", ["ab", "c"]), ("<p>a<!-- x", ["a"]), ('<p class=a">t "q" more</p>', ['t "q" more']), ("<p title='a>b'>t", ["t"]), ('<p title="a>t', ["t"]),
        ("&#0000000065;&#x0000041;" + "&#" + "9" * 6000 + ";", ["AA\ufffd"]), ("<svg/><p>t", ["t"]), ("<SCRIPT>x</scriptx></script y>t", ["t"]),
    ],
)
def test_blocks_of_odd_markup(page, texts):
    assert [b.text for b in html_blocks.leaf_blocks(page)] == texts


def test_path_vectors_follow_the_path():
    """The vector that is kept while scanning is that of the path's distinct tokens."""
    rng = random.Random(4)
    tags = ["<div class='a b'>", "<p>", "</p>", "<ul id=a>", "<li>", "</ul>", "</div>", "<i>", "<a href=x>", "</a>", "</i>", "<td>", "<section role=b>", "</section>", "<b>"]
    page = "".join(rng.choice(tags) + rng.choice(["", "t "]) for _ in range(3000))
    for b in html_blocks.leaf_blocks(page):
        want = np.zeros(html_blocks.PATH_DIMS, int)
        for token in set(b.path):
            slot, sign = html_blocks._path_slot(token)
            want[slot] += sign
        assert (np.frombuffer(b.mark, np.int32) == want).all()


@pytest.mark.parametrize(
    "unit",
    ["<div>x", "<" + "a" * 1000 + " '", '<a b="', "<!--x", "<div></section>", "<i><div><b></i>", "<center><h1></h1>", "<script></script", "&#99999999", "<p class='a b c'>x<!-->"],
)
def test_long_odd_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    html_blocks.leaf_blocks(page)
    assert time.perf_counter() - start < 5


def test_a_page_of_many_blocks_is_labelled():
    page = "<article>" + "<div>some words of a block." * 10_000
    start = time.perf_counter()
    text = html_extract.main_texts(html_extract.load(), [page])[0]
    assert isinstance(text, str) and time.perf_counter() - start < 20


def test_one_loop_labels_as_two(spark):
    """Inference runs both directions at once; training runs them one by one."""
    model = html_extract.load()
    x, _, m = html_training._padded(html_training.examples(12, 5))
    two = np.concatenate([model._run(x, m, d) for d in "fb"], axis=2) @ model.w["o"] + model.w["p"]
    assert np.abs(two - model.logits(x, m))[m > 0].max() < 1e-3


def test_labeller_on_unseen_pages():
    blocks, pages = html_training.accuracy(html_extract.load(), html_training.examples(150, 77))
    assert blocks > 0.99 and pages > 0.9


def test_gradients_are_right():
    data = html_training.examples(3, 1)
    model = html_extract.BiLSTM.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y, m = html_training._padded(data)
    _, grad = html_training.gradients(model, x, y, m)
    for k, at in (("xf", (3, 5)), ("xb", (html_blocks.DIMS - 2, 30)), ("hf", (1, 2)), ("hb", (4, 70)), ("cf", (30,)), ("cb", (80,)), ("o", (5,)), ("p", (0,))):
        keep = model.w[k][at]
        loss = []
        for e in (1e-3, -1e-3):
            model.w[k][at] = keep + e
            loss.append(html_training.gradients(model, x, y, m)[0])
        model.w[k][at] = keep
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[k][at]) < 1e-4


def test_padding_does_not_change_labels():
    model = html_extract.load()
    data = [v for v, _ in html_training.examples(20, 4)]
    together = model.label(data)
    assert all((model.label([v])[0] == t).all() for v, t in zip(data, together))
    assert model.label([]) == [] and len(model.label([data[0][:0]])[0]) == 0


def test_html_query(spark, sf_dir):
    """The pages' articles, cut out by their tags."""
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    right = 0
    for r in op8_html_extract(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        right += r["text"] == want
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
    assert right >= 0.96 * len(pages)


def test_html_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "plain words only here."), (3, "plain words only here."), (4, "<article><h1>T</h1>" + "<p>some words of text.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == got[2] == "" and len(got[4].split()) >= 11_000
    assert html_extract.extract(df.limit(0)).count() == 0


# --- columns that clash ---------------------------------------------------------------------------


def test_extra_columns_of_any_name(spark, codec):
    """Operators keep extra columns whose names hold dots or equal the ones they use inside."""
    from quarry.llm import exact_dedup, near_dedup, url_filter

    names = ["doc_id", "text", "source", "n_chars", "a.b", "_text", "_id", "_uid", "_sha", "c_0", "_runs", "_size", "_gone", "_toxicity", "score", "_url", "_html", "doc", "n"]
    kinds = ["long", "string", "string", "long"] + ["string"] * (len(names) - 4)
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    rows = [(i, f"some text number {i} of a few words blarg zonk" if i % 5 else "clean words only here today", "s", 5, *["x"] * (len(names) - 4)) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(1, 30)], "doc_id long, toxic int")
    assert bpe.with_tokens(docs, codec).count() == 29
    assert secrets.find_secrets(docs).columns[: len(names)] == names
    assert toxicity.drop_toxic(docs, labels).columns == names
    assert exact_dedup.drop_exact_copies(docs).columns == names and exact_dedup.drop_exact_copies(docs).count() == 25
    assert near_dedup.keep_one_of_each(docs).columns == names
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == names and {r["a.b"] for r in mixed.select("`a.b`").collect()} == {"x"}
    pages = docs.withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert html_extract.extract(pages).count() == url_filter.judge_urls(pages).count() == 29
