import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import codecs, glob, scalars as s
from quarry.operators.sync import should_include


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "n, text", [(0, "0 B"), (1000, "1000 B"), (1001, "0.98 KiB"), (1024, "1.00 KiB"), (10240, "10.0 KiB"), (102400, "100 KiB"), (-5, "-5 B"), (1 << 40, "1.00 TiB")]
)
def test_human_size(spark, n, text):
    assert one(spark, s.human_size(F.lit(n))) == text


def test_human_size_rounds_the_exact_value(spark):
    """As C's printf does: no decimal that only looks like a tie is rounded as one."""
    rng = random.Random(2)
    sizes = [rng.randrange(1001, 1 << rng.randrange(11, 63)) for _ in range(3000)] + [1024**k * n // 400 for k in range(1, 7) for n in range(400, 3300, 7)]
    sizes += [int((n + 0.5) * 1024**k / 100) + e for k in range(1, 7) for n in range(100, 790, 13) for e in (-1, 0, 1)]

    def printed(n):
        value, unit = float(n), 0
        while unit < 6 and value > 1000:
            value, unit = value / 1024, unit + 1
        return f"{value:.{(2 if value < 10 else 1 if value < 100 else 0) if unit else 0}f} {s.UNITS[unit]}"

    df = spark.createDataFrame([(n,) for n in sizes if n < 1 << 63], "n long")
    assert [r for r in df.select("n", s.human_size(F.col("n")).alias("x")).collect() if printed(r["n"]) != r["x"]] == []


def test_human_size_query_ends_at_its_largest_unit(spark, tmp_path):
    from quarry import queries as q
    from tests.oracle import connect, same_rows

    rows = [(k,) for k in (0, 31, 32, 1036215, 1036216, 9_000_000, 3_000_000_000)]
    spark.createDataFrame(rows, "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    assert same_rows(q.queries()["human_size"](spark, str(tmp_path)), connect(tmp_path), q.oracle_sql()["human_size"]) == 7


def test_short_and_compact_sizes(spark):
    assert one(spark, s.short_human_size(F.lit(2048))) == "2.00K"
    assert one(spark, s.compact_human_size(F.lit(5))) == "5B"


def test_block_id(spark):
    links = [hashlib.md5(x).hexdigest() for x in (b"a", b"b")]
    want = hashlib.md5(struct.pack(">I", 2) + b"".join(map(bytes.fromhex, links)) + struct.pack(">I", 6) + b"HELLO!").hexdigest()
    col = s.block_id(F.array(*[F.lit(x) for x in links]), F.lit("HELLO!"))
    assert one(spark, col) == want
    for id_, ls, data, ok in [(want, links, "HELLO!", True), ("ff" + want[2:], links, "HELLO!", False), (want, links[::-1], "HELLO!", False), (want, links, "hELLO!", False)]:
        assert one(spark, s.verify_block(F.lit(id_), F.array(*[F.lit(x) for x in ls]), F.lit(data))) is ok


@pytest.mark.parametrize(
    "depth, key, text, digest",
    [
        (1, b"", b"", "74e6f7298a9c2d168935f58c001bad88"),
        (1, b"Jefe", b"what do ya want for nothing?", "750c783e6ab0b503eaa86e310a5db738"),
        (1, b"key", b"The quick brown fox jumps over the lazy dog", "80070713463e7749b90c2dc24911e275"),
        (20, b"", b"", "64139538fd1a40dae8c3f99324f1f9a9"),
        (20, b"Jefe", b"what do ya want for nothing?", "36b3f7b29692fbbf076d4cce1f9bbd2f"),
        (20, b"key", b"The quick brown fox jumps over the lazy dog", "56881e862a44cbf94e92c5bf0bdbc497"),
    ],
)
def test_keyed_hash(spark, depth, key, text, digest):
    assert codecs.keyed_hash(key, text, depth).hex() == digest
    assert one(spark, F.hex(codecs.keyed_hash_udf(key, depth)(F.lit(text)))).lower() == digest


def test_cipher_round_trip(spark):
    key, iv, data = (F.lit(bytes(range(i, i + 16))) for i in (0, 50, 100))
    cipher = codecs.encrypt_block(data, key, iv)
    assert len(one(spark, cipher)) == 16
    assert bytes(one(spark, codecs.decrypt_block(cipher, key, iv))) == bytes(range(100, 116))


def test_compression_is_not_part_of_the_content(spark):
    text = b"lots-of-repeated-data-1234567890-" * 1000
    packed = codecs.deflate(F.lit(text))
    assert len(one(spark, packed)) < len(text)
    assert bytes(one(spark, codecs.payload(packed, F.lit(codecs.ZLIB)))) == text
    assert bytes(one(spark, codecs.payload(F.lit(text), F.lit(codecs.RAW)))) == text
    assert one(spark, codecs.payload(F.lit(b"no zlib"), F.lit(codecs.ZLIB))) is None


def test_ids_and_times(spark):
    assert one(spark, s.hex64(F.lit(-1))) == "f" * 16
    assert one(spark, s.int64_of_hex(F.lit("f" * 16))) == -1
    assert one(spark, s.index_slot(F.lit("00" * 13 + "000102"))) == 16 + 24 * 0x102
    packed = s.pack_location(F.lit(16383), F.lit((1 << 34) - 1))
    assert one(spark, F.struct(*s.unpack_location(packed))) == (16383, (1 << 34) - 1)
    assert one(spark, s.numbered_file(F.lit(255), "dat")) == "000000FF.dat"
    assert one(spark, s.plausible_time(F.lit(0))).strip() == ""
    assert one(spark, s.plausible_time(F.lit(946684800 * 10**9))) == "2000-01-01T00:00:00Z"
    assert one(spark, s.plausible_time(F.lit(946684799 * 10**9))).strip() == ""
    assert one(spark, s.nice_date(F.lit(946684800 * 10**9), F.lit(946684800 * 10**9))) == "Jan  1 00:00"
    assert one(spark, s.nice_date(F.lit(946684800 * 10**9), F.lit(1700000000 * 10**9))) == "Jan  1  2000"
    assert one(spark, s.compare_ids(F.lit("7f"), F.lit("80"))) == -1


def test_text_functions(spark):
    assert one(spark, s.escape_controls(F.lit("a\x00\n\x7fb"))) == "a\\x00\\x0a\\x7fb"
    assert one(spark, s.split_path(F.lit("/a//b/./c/../d/"))) == ["a", "b", "d"]
    assert one(spark, s.safe_file_name(F.lit('a\\b/c:d*e?f"g<h>i|j'))) == "a_b_c_d_e_f_g_h_i_j"
    assert s.expand_env("$A/${B}/$$X/$C", {"A": "1", "B": "2"}) == "1/2/$X/"
    line = one(spark, s.hexdump_line(F.lit(16), F.lit(b"0123456789\x00\xffabcd")))
    assert line == "00000010  30 31 32 33 34 35 36 37  38 39 00 ff 61 62 63 64  |0123456789..abcd|"
    assert one(spark, s.parse_hash(F.lit("nonsense"))) is None


@pytest.mark.parametrize(
    "pattern, text, hit",
    [("*", "abc", True), ("*", "a/c", False), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a.c", "abc", False), ("a*/b", "ax/b", True)],
)
def test_glob(spark, pattern, text, hit):
    assert one(spark, F.lit(text).rlike(glob.glob_regex(pattern))) is hit


@pytest.mark.parametrize("bad", ["[", "[a", "a\\"])
def test_bad_glob(bad):
    with pytest.raises(ValueError):
        glob.glob_regex(bad)


def test_first_ignore_wins(spark):
    ignores = glob.compile_ignores([*glob.UNIX_IGNORES, "*.tmp", "x/", "$NONE"])
    def by(path, is_dir):
        return one(spark, glob.ignored_by(F.lit(path), F.lit(is_dir), ignores))
    assert by("/dev/null", False) == "/dev/*" and by("/a/b.tmp", False) == "*.tmp"
    assert by("/a/x", True) == "x/" and by("/a/x", False) is None and by("/a/lost+found", True) == "lost+found/"


@pytest.mark.parametrize(
    "account, dataset, include, exclude, want",
    [
        ("root", "", ["root"], [], True), ("root", "", ["root:dataset-alpha"], [], True), ("root", "", ["other:dataset-alpha"], [], False),
        ("root", "", ["root"], ["root"], False), ("root", "", ["root"], ["root:"], False), ("root", "", ["root"], ["root:dataset-alpha"], True),
        ("root", "dataset-alpha", ["root:dataset-alpha"], [], True), ("root", "dataset-alpha", ["root"], ["root:dataset-alpha"], False),
        ("root", "dataset-beta", ["root"], ["root:dataset-alpha"], True), ("root", "dataset-beta", ["root:dataset-alpha"], [], False),
        ("root", "dataset-alpha", [], [], True),
    ],
)
def test_should_include(spark, account, dataset, include, exclude, want):
    assert one(spark, should_include(F.lit(account), F.lit(dataset), include, exclude)) is want


def test_default_ignores_by_platform(spark):
    from quarry.functions import glob

    for platform in ("linux", "darwin", "win32"):
        sep = glob.separator_of(platform)
        env = {"TMPDIR": "/var/t", "TMP": "C:\\t", "TEMP": "C:\\u", "USERPROFILE": "C:\\me"}
        assert glob.compile_ignores(glob.default_ignores(platform, f"{sep}home{sep}x"), env, sep)
    win = glob.compile_ignores(glob.default_ignores("win32", "C:\\hb"), {"USERPROFILE": "C:\\me"}, "\\")
    rows = [
        ("C:\\$RECYCLE.BIN", True, "$$RECYCLE.BIN\\"), ("D:\\x\\Thumbs.db", False, "Thumbs.db"), ("C:\\pagefile.sys", False, "*\\pagefile.sys"), ("C:\\hb\\a.cache.tmp", False, "C:\\hb\\*.cache*"),
        ("C:\\me\\Local Settings\\Temporary Internet Files", True, "$USERPROFILE\\Local Settings\\Temporary Internet Files\\"), ("C:\\x\\hb\\a.cache", False, None), ("C:\\Windows\\Temp", False, None), ("C:\\Windows\\Temp", True, "*\\Windows\\Temp\\"),
    ]
    df = spark.createDataFrame(rows, "path string, is_dir boolean, want string")
    for r in df.withColumn("got", glob.ignored_by(F.col("path"), F.col("is_dir"), win, "\\")).collect():
        assert r["got"] == r["want"], r
    mac = glob.compile_ignores(glob.default_ignores("darwin"), {"TMPDIR": "/var/t"})
    rows = [("/Users/me/Library/Caches", True, "/Users/*/Library/Caches/"), ("/x/.Spotlight-V100", True, ".Spotlight-V*"), ("/var/t", True, "$TMPDIR"), ("/proc/1", True, "/proc/*"), ("/Users/me/Library", True, None)]
    for r in spark.createDataFrame(rows, "path string, is_dir boolean, want string").withColumn("got", glob.ignored_by(F.col("path"), F.col("is_dir"), mac)).collect():
        assert r["got"] == r["want"], r


def test_derived_keys():
    import hashlib
    import hmac

    from quarry.functions import codecs

    def deep(data, key):
        for _ in range(20_000):
            data = hmac.new(key, data, hashlib.md5).digest()
        return data

    secret = hashlib.md5("pässword".encode()).digest()
    assert codecs.access_key("acc", "pässword") == deep(b"acc*ACCESS*KEY*PAD*", secret)
    assert codecs.backup_key("acc", "pässword") == deep(b"acc*ENCRYPTION*PAD*", secret)
    assert codecs.session_key("acc", b"n" * 16, b"k" * 16) == deep(hashlib.md5(b"acc").digest() + b"n" * 16, b"k" * 16)
    assert len(codecs.data_key()) == 16 and codecs.data_key() != codecs.data_key()


def test_scratch_tables_need_a_shared_folder(spark, tmp_path, monkeypatch):
    from quarry.plans import scratch

    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        sparkContext = Elsewhere()

        class conf:
            value = None

            @classmethod
            def get(cls, key, default=None):
                return cls.value or default

    import pytest

    with pytest.raises(RuntimeError):
        scratch.shared_base(Session())
    Session.conf.value = "/shared/"
    assert scratch.shared_base(Session()) == "/shared"
    kept = scratch.Scratch(spark, "kept").table(spark.range(3))
    with scratch.released():
        inner = scratch.Scratch(spark, "inner")
        inner.table(spark.range(5))
        assert inner in scratch._open
    assert inner not in scratch._open and kept.count() == 3
    import os

    assert not os.path.exists(inner.root.removeprefix("file://"))


def test_closure_of_deep_graphs(spark, monkeypatch):
    """A chain, a cycle and a fan, with runs merged often."""
    import random

    from quarry.plans import fixpoint

    monkeypatch.setattr(fixpoint, "RUNS", 2)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(9)] + [(9, 3), (2, 20), (20, 21), (100, 101)] + [(4, 30 + k) for k in range(15)] + [(30 + rng.randrange(15), 60 + k) for k in range(9)]
    out, level, depth = {0: 0}, [0], 0
    while level:
        depth += 1
        level = sorted({b for a, b in edges if a in level} - set(out))
        out.update(dict.fromkeys(level, depth))
    got = fixpoint.closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (0,)], "node long"))
    assert sorted(map(tuple, got.select("node", "level").collect())) == sorted(out.items())


def test_simple_upper_is_the_sql_upper(spark):
    import duckdb

    texts = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(texts[i : i + 97]) for i in range(0, len(texts), 97)] + ["stra\u00dfe \u00f1 \u00df\u00df", "\u00df", "", None, "a\n\ufb01n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    got = [r["u"] for r in df.select("i", s.simple_upper(F.col("t")).alias("u")).orderBy("i").collect()]
    want = [r[0] for r in duckdb.execute("SELECT upper(t) FROM (SELECT unnest(?) AS t)", [texts]).fetchall()]
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []


def test_unreadable_kept_with_sharp_s(spark, tmp_path):
    from quarry import queries as q
    from tests.oracle import connect, same_rows

    rows = [(k, f"gro\u00df {k}", lang, source, 6) for k, (lang, source) in enumerate(((a, b) for a in ("es", "de", "fr", "en") for b in ("src1", "src2") for _ in range(4)), 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert same_rows(q.queries()["unreadable_kept"](spark, str(tmp_path)), connect(tmp_path), q.oracle_sql()["unreadable_kept"]) == 20
