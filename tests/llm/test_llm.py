"""Operators for training data: against libraries, brute force and round trips; nulls, empties, ties, clashing columns."""

import hashlib
import itertools
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, fertility, linededup, linkgraph, mixing, neardup, queries, reshard, tiff, tokenfile, toxicity
from vellum.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns whose names clash with results."""
    long = "word " * 40_000
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n\t ", "xx", None, 5), (3, long, "de", "a", len(long)), (4, "x" * 100_000, "en", "b", 1), (5, "same words here in this text again", "en", "a", 1), (5, "same words here in this text again", "en", "a", 1), (6, "same words here in this text again", "fr", "b", 1), (7, "<|endoftext|> don't  stop\r\n ", "en", "b", 1)]
    return spark.createDataFrame([(*r, "i", "s") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, ours = Tokenizer.from_file(path), bpe.Encoder(bpe.ByteBpe(path))
    r = random.Random(7)
    letters = [*"abc  \n\t's é 　\x85\x1c\x1fß中🎉123,.!|aaaa", "<|endoftext|>", "don't", "  ", "\r\n", "​"]
    texts = ["", " ", "a", "aaaaaaaaa", *("".join(r.choices(letters, k=r.randrange(60))) for _ in range(3000))]
    ids, counts = ours.encode(texts)
    at = 0
    for text, n, e in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, repr(text)
        assert ours.bpe.decode_bytes(ids[at : at + n]).decode("utf-8", "replace") == library.decode(e.ids, skip_special_tokens=False)
        at += n


def test_bpe_documents(spark, odd, none):
    back = bpe.decode_documents(bpe.encode_documents(odd))
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert bpe.round_trip(odd).count() == odd.count() and bpe.round_trip(none).count() == 0


def test_token_files(spark, odd, none, tmp_path):
    uri = f"file://{tmp_path}/a"
    manifest = tokenfile.write(odd, uri)
    rows = tokenfile.read_checks(spark, uri, manifest).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    ids = {r.doc_id: r.ids for r in tokenfile.read_ids(spark, uri, manifest).collect()}
    assert ids[1] == [tokenfile.END_ID] and all(x.tolist() == ids[5] for x in tokenfile.read_document(uri, 5)) and len(tokenfile.read_document(uri, 5)) == 2
    assert zlib.crc32(np.array(ids[7], "<u4").tobytes()) == next(r.ids_crc32 for r in rows if r.doc_id == 7)
    assert tokenfile.read_document(uri, 99) == []
    empty = tokenfile.write(none, f"file://{tmp_path}/b")
    assert tokenfile.read_checks(spark, f"file://{tmp_path}/b", empty).count() == 0


def test_token_files_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    start = 0
    for r in queries.op5_tokenfile(spark, DIR).orderBy("doc_id").collect():
        ids = [*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_flow_moves_the_fewest_bytes():
    r = random.Random(3)
    for n, m in [(4, 4)] * 50 + [(2, 6), (6, 2), (1, 1), (1, 5)]:
        sizes = [r.randrange(9) for _ in range(n)]
        caps = [r.randrange(9) for _ in range(m - 1)]
        caps.append(max(0, sum(sizes) - sum(caps)))
        flow = reshard.min_cost_flow(sizes, caps)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == sizes
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= caps[k] for k in range(m))
        # what can stay does, so the rest is all that moves
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(sizes) - sum(map(min, sizes, caps))
    with pytest.raises(ValueError, match="hold less"):
        reshard.min_cost_flow([2], [1])
    many = reshard.min_cost_flow([7] * 10_000, [14] * 5_000)
    assert sum(many.values()) == 70_000 and sum(v for (i, j), v in many.items() if i != j) == 35_000


def test_shards(spark, odd, none):
    rows = reshard.documents_in_shards(odd, 2)
    placed = reshard.reshard(rows, 3, 2, Scratch(spark, "t"))
    assert placed.columns == [*rows.columns, "shard", "slot"]
    placed = placed.collect()
    assert len(placed) == odd.count()
    for k in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed)))
    assert reshard.reshard(reshard.documents_in_shards(none, 2), 3, 2, Scratch(spark, "t")).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    sizes = [r[1] for r in reshard.reshard(reshard.documents_in_shards(many, 32), 40, 32, Scratch(spark, "t")).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 500


def test_rows_of_no_shard_and_no_size(spark):
    """Null, negative and unknown shards, null and negative sizes: every row gets a place, those without a shard move."""
    rows = [(k, [10, None, -5][k % 3], [0, 1, None, 7, -1][k % 5]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, size long, old_shard int")
    for shards in (1, 2, 3, 9):
        got = reshard.reshard(df, shards, 2, Scratch(spark, "t")).collect()
        assert len(got) == 300 and {r.shard for r in got} <= set(range(shards))
        for k in range(shards):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        loads = [sum(max(r["size"] or 0, 0) for r in got if r.shard == k) for k in range(shards)]
        assert max(loads) - min(loads) <= 30
    assert reshard.reshard(df.where("size < 0"), 3, 2, Scratch(spark, "t")).count() == 100


def test_rewrite_touches_changed_shards_alone(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("xxxx").alias("text"), F.when(F.col("id") < 60, 0).when(F.col("id") < 90, 1).otherwise(2).cast("int").alias("old_shard"))
    rows = docs.withColumn("size", F.lit(1).cast("long"))
    plan = reshard.plan(rows, [50, 30, 20], 3, Scratch(spark, "t"))
    back = reshard.rewritten(rows, plan, str(tmp_path / "new")).collect()
    assert plan.changed == [0, 2]
    new = spark.read.parquet(str(tmp_path / "new"))
    assert {r["shard"]: r["count"] for r in new.groupBy("shard").count().collect()} == {0: 50, 2: 20}
    assert len(back) == 100 and {k: sorted(r.slot for r in back if r.shard == k) for k in range(3)} == {0: list(range(50)), 1: list(range(30)), 2: list(range(20))}
    assert {r.doc_id for r in back if r.shard == 1} == set(range(60, 90)) and {r.text for r in back} == {"xxxx"}


def test_shards_of_the_documents(spark):
    """The query's rows, read back from the files: sizes, hashes, near equal shards, gapless slots; every text once."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = queries.op3_flow_reshard(spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for k in range(40):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_mixing(spark, odd, none):
    sized = odd.withColumn("size", mixing.words())
    mixed = mixing.mix(sized).collect()
    assert len(mixed) == odd.count() and all(r.copies <= 2 for r in mixed)
    assert mixing.mix(none.withColumn("size", mixing.words())).count() == 0
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want, weight = {"a": 10, "b": 1000, "c": 100, None: 50}, {"a": 3, "b": 1, "c": 2, None: 3}
    capped: set = set()
    while True:
        level = (1.5 * sum(want.values()) - sum(2 * want[k] for k in capped)) / sum(w for k, w in weight.items() if k not in capped)
        over = {k for k in want if k not in capped and level * weight[k] > 2 * want[k]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({k: 2 * want[k] if k in capped else level * weight[k] for k in want})
    assert mixing.repeat(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, copies int")).count() == 3


def test_line_dedup(spark, odd, none):
    def freed(df, **more):
        return linededup.drop_lines(df, "site", Scratch(spark, "t"), **more)

    assert linededup.drop_lines(odd, "source", Scratch(spark, "t")).count() == odd.count() and linededup.drop_lines(none, "source", Scratch(spark, "t")).count() == 0
    rows = [(k, f"menu\nown {k}\n\n menu ", "a") for k in range(9)] + [(10, "menu\nx", "b"), (11, None, "a")]
    got = {r.doc_id: r.text for r in freed(spark.createDataFrame(rows, "doc_id long, text string, site string"), ratio=0.5).collect()}
    assert got == {k: f"own {k}\n" for k in range(9)} | {10: "menu\nx", 11: None}


def test_copies_are_one_page_of_their_site(spark):
    """600 copies of one text keep their lines; the menu of 20 different texts goes from all, copies too."""
    rows = [(k, f"menu\nown {k}", "a") for k in range(20)] + [(100 + k, "menu\nfirst\nsecond", "a") for k in range(600)] + [(1000 + k, None, "a") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string")
    got = {r.doc_id: r.text for r in linededup.drop_lines(df, "site", Scratch(spark, "t"), ratio=0.5).collect()}
    assert got == {k: f"own {k}" for k in range(20)} | {100 + k: "first\nsecond" for k in range(600)} | {1000 + k: None for k in range(300)}


def test_lines_of_hosts(spark):
    """The pages' html, a line to each tag, by the host of their url, as plain counting gives it."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet").withColumn("host", linkgraph.host_of(F.col("url"))).withColumn("html", F.replace("html", F.lit(">"), F.lit(">\n")))
    got = {r.page_id: r.html for r in linededup.drop_lines(pages, "host", Scratch(spark, "t"), text="html").collect()}
    rows, carried, texts = pages.collect(), {}, {}
    for r in rows:
        texts.setdefault(r.host, set()).add(r.html)
    for host, them in texts.items():
        for text in them:
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                carried[host, line] = carried.get((host, line), 0) + 1
    bad = {key for key, n in carried.items() if n >= linededup.LEAST and n > linededup.RATIO * len(texts[key[0]])}
    want = {r.page_id: r.html if r.html is None else "\n".join(x for x in r.html.split("\n") if (r.host, x.strip(" ")) not in bad) for r in rows}
    assert got == want and bad


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?y", "x://net", "http://b.org/fr/", "http://b.org/f", "no url", None, "http://example.com/de/#", "http://notexample.com/de/", "a://NET/?q", "http://u.net?x/", "ftp://h://i/j"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = [(r.host, r.path, r.rule) for r in linkgraph.judge(df, Scratch(spark, "t")).orderBy("page_id").collect()]
    assert got == [("a.example.net", "/en/x", "example.net/en/"), ("net", "", None), ("b.org", "/fr/", "org/fr/"), ("b.org", "/f", None), ("", "", None), ("", "", None), ("example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/", None), ("net", "/", "net/"), ("u.net", "", None), ("h:", "//i/j", None)]
    assert linkgraph.judge(df.limit(0), Scratch(spark, "t")).count() == 0


def test_distrust_runs_against_links(spark):
    def page(k, url, *to):
        return (k, url, "".join(f'<a href="http://{t}/">x</a>' for t in to))

    rows = [page(0, "http://bad.net/"), page(1, "http://farm.info/", "bad.net"), page(2, "http://fan.info/", "farm.info"), page(3, "http://good.org/fr/", "friend.info"), page(4, "http://friend.info/"), page(5, "http://alone.info/")]
    got = {r.host: r for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"bad.net": "block", "farm.info": "block", "fan.info": "block", "good.org": "allow", "friend.info": "allow", "alone.info": "allow"}
    rank, seed, links = {"good.org": 1.0}, {"good.org": 1.0}, {("good.org", "friend.info"): 1.0}
    for _ in range(100):
        rank = {h: 0.15 * seed.get(h, 0) + sum(0.85 * rank.get(a, 0) * w for (a, b), w in links.items() if b == h) for h in got}
    assert got["friend.info"].trust == pytest.approx(rank["friend.info"] * 6)


def test_hosts_with_few_blocked_pages_are_seeds(spark):
    """Two of five pages are blocked: the site that links to the host is blocked, the host's other pages stay."""
    rows = [(k, f"http://example.com/{'de' if k < 2 else 'x'}/", "") for k in range(5)] + [(5, "http://fan.info/", '<a href="http://example.com/">x</a>')] + [(6 + k, f"http://alone{k}.info/", "") for k in range(4)]
    got = {r.page_id: r.verdict for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, 1, 5}


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_tiff_round_trip(kind, tile):
    r = np.random.default_rng(5)
    images = [r.integers(0, 4, (37, 21, s), np.uint8) for s in (1, 3)] + [np.zeros((500, 60, 1), np.uint8), r.integers(0, 60_000, (20, 7, 3)).astype(np.uint16)]
    for predictor, order in itertools.product((1, 2), "<>"):
        found = list(tiff.pages(tiff.write(images, kind, predictor, 10, tile, order)))
        assert [p.data for p in found] == [i.tobytes() for i in images]


def test_lzw_and_packbits_against_plain_forms():
    r = random.Random(1)
    for n in (0, 1, 2, 255, 5000, 70_000):
        raw = bytes(r.choices(range(3 if n % 2 else 256), k=n))
        assert tiff.unpack_lzw(tiff.pack_lzw(raw)) == raw and tiff.unpack_bits(tiff.pack_bits(raw)) == raw
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == bytes.fromhex("aaaaaa80002aaaaaaaaa")
    values = np.linspace(0, 1, 12, dtype=np.float32).reshape(3, 4)
    planes = values.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    rows = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8)
    assert tiff.undo(rows.tobytes(), "<", 3, 4, 1, 32, 3).tobytes() == values.astype("<f4").tobytes()


def tiff_of_bits(values, bits, codec, order="<", fill=1, planar=1, change=()):
    """A file of one strip for each plane, with each row's samples packed from the high bit on."""
    height, width, samples = values.shape
    planes = [values] if planar == 1 else [values[:, :, k : k + 1] for k in range(samples)]
    strips = []
    for plane in planes:
        rows = ["".join(f"{v:0{bits}b}" for v in row.flatten().tolist()) for row in plane]
        raw = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8)) for r in rows)
        packed = tiff.PACK[codec](raw)
        strips.append(bytes(int(f"{b:08b}"[::-1], 2) for b in packed) if fill == 2 else packed)
    fields = {256: [width], 257: [height], 258: [bits], 259: [codec], 262: [1], 266: [fill], 277: [samples], 278: [height], 284: [planar]}
    at = 8
    fields[273], fields[279] = [], []
    for s in strips:
        fields[273].append(at)
        fields[279].append(len(s))
        at += len(s)
    fields = {t: v for t, v in sorted((fields | dict(change)).items()) if v is not None}
    after = at + 2 + 12 * len(fields) + 4
    directory, rest = struct.pack(order + "H", len(fields)), b""
    for tag, values in fields.items():
        said = struct.pack(f"{order}{len(values)}I", *values)
        if len(said) > 4:
            said, rest = struct.pack(order + "I", after + len(rest)), rest + said
        directory += struct.pack(order + "HHI", tag, 4, len(values)) + said
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(strips) + directory + bytes(4) + rest


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_samples_below_a_byte(bits, codec):
    r = np.random.default_rng(bits)
    for shape, order, fill, planar in (((5, 13, 1), "<", 1, 1), ((7, 9, 3), ">", 2, 1), ((4, 11, 3), "<", 2, 2), ((1, 1, 1), ">", 1, 1), ((40, 3001, 1), "<", 1, 1)):
        values = r.integers(0, 2**bits, shape, np.uint8)
        (page,) = tiff.pages(tiff_of_bits(values, bits, codec, order, fill, planar))
        assert (page.bits, page.width, page.height, page.samples, page.data) == (bits, shape[1], shape[0], shape[2], values.tobytes())


def test_tiff_bits_by_default_and_what_is_refused():
    values = np.array([[[1], [0], [1]]], np.uint8)
    (page,) = tiff.pages(tiff_of_bits(values, 1, tiff.NONE, change={258: None}))
    assert page.data == b"\1\0\1"
    blank = np.zeros((3000, 8000, 1), np.uint8)  # a blank scan unpacks to far more than its file's bytes
    (page,) = tiff.pages(tiff_of_bits(blank, 1, tiff.PACKBITS))
    assert page.data == blank.tobytes()
    (page,) = tiff.pages(tiff_of_bits(values, 1, tiff.NONE, change={317: [2]}))
    assert page.error == "damaged: predictor 2 with 1 bits a sample"
    for empty in (b"II*\0" + bytes(4), b"MM\0*" + bytes(4), b"II+\0\x08\0\0\0" + bytes(8)):
        (page,) = tiff.pages(empty)
        assert (page.page, page.error) == (0, "damaged: no directory")


def test_tiff_rows(spark, odd, none):
    files = tiff.store_documents(odd).withColumnRenamed("doc_id", "file_id")
    bad = spark.createDataFrame([(90, None), (91, bytearray(b"II*\0\xff\xff\0\0")), (92, bytearray(b"junk"))], "file_id long, content binary")
    got = tiff.explode_pages(files.unionByName(bad))
    assert got.where("error is null").count() == odd.count() and got.where("error is not null").count() == 3
    rows = tiff.round_trip(odd).collect()
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes) for r in rows) and tiff.round_trip(none).count() == 0
    assert len({r.media_sha256 for r in rows if r.doc_id in (5, 6)}) == 1


def test_tiff_query_against_its_contract(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    long = {-1: "long text " * 200_000, -2: ""}  # three pages; one row of spaces
    more = spark.createDataFrame(list(long.items()), "doc_id long, text string")
    rows = [*queries.op10_tiff(spark, DIR).collect(), *tiff.round_trip(more).collect()]
    assert len(rows) == len(docs) + 2
    for r in rows:
        raw = (docs | long)[r.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = tiff.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        flat = list(payload)
        n = len(flat)
        means = "/".join(str(sum(flat[k::3]) * 100 // (n // 3)) for k in range(3))
        found, rest = r.feature.split(":", 1)
        assert rest == f"{sum(flat) * 100 // n}:{sum(x * x for x in flat) // n}:{means}"
        assert found.split("x")[0] == str(-(-n // (192 * tiff.PAGE_ROWS)))
    codecs = {next(iter(tiff.pages(tiff.store(tiff.payload_of(t))))).compression for t in docs.values()}
    assert codecs == {tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE}


def test_tiff_pages_behind_a_bad_one(spark):
    images = [np.full((4, 5, 1), k, np.uint8) for k in range(3)]
    whole = bytearray(tiff.write(images, tiff.NONE, 1))
    at = whole.index(struct.pack("<HHI", tiff.COMPRESSION, 3, 1))
    fax, huge = bytearray(whole), bytearray(whole)
    fax[at + 8 : at + 10] = struct.pack("<H", 3)
    wide = whole.index(struct.pack("<HHI", tiff.WIDTH, 4, 1))
    huge[wide + 8 : wide + 12] = struct.pack("<I", 1 << 31)
    files = spark.createDataFrame([(1, fax, "a"), (2, huge, "b")], "file_id long, content binary, name string")
    rows = sorted(tiff.explode_pages(files, ["name"]).collect(), key=lambda r: (r.file_id, r.page))
    assert [(r.file_id, r.page, r.error is None, r.name) for r in rows] == [(f, p, p > 0, n) for f, n in ((1, "a"), (2, "b")) for p in range(3)]
    assert all(r.data == images[r.page].tobytes() for r in rows if r.page)
    bomb = tiff.write([np.zeros((4, 5, 1), np.uint8)], tiff.DEFLATE, 1)
    assert len(tiff.inflate(zlib.compress(bytes(1 << 24)), 100)) == 100 and len(list(tiff.pages(bomb))) == 1


@pytest.mark.parametrize("most", [1 << 21, 1 << 31])
def test_repeated_words_of_many_words(most):
    """Texts of more different words than fit a third of a key."""
    r = np.random.default_rng(3)
    numbers = np.array([0, 1, 5, most // 2, most // 2 + 5, most - 1, most // 4 + 5, 1 << 20])
    for n in (0, 1, 3, 4, 40, 300):
        words = numbers[r.integers(0, len(numbers), n)]
        windows = [tuple(words[k : k + 3]) for k in range(n - 2)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert fertility.repeated_words(words) == len(hit)


def test_fertility_counts(spark, odd, none):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(twice)

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op2_fertility(spark, DIR).collect():
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert fertility.score(odd).count() == odd.count() and fertility.score(none).count() == 0


def brute_components(docs, percent=85):
    sets = {}
    for k, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {k: (len(sets[k]), root(k)) for k in sets}


def copies(n=60):
    r = random.Random(11)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    docs = {0: " ".join(base)}
    for k in range(1, n):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        docs[k] = " ".join(w)
    return docs | {n: "", n + 1: None, n + 2: "A b", n + 3: "a B", n + 4: docs[3].upper()}


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies(spark, monkeypatch, small):
    """The second time all buckets of three sets or more go by pivots and prefixes."""
    monkeypatch.setattr(neardup, "SMALL", small)
    docs = copies()
    got = neardup.components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(docs)


@pytest.mark.parametrize("n", [240, 720])
def test_near_copies_of_one_source(spark, monkeypatch, n):
    """Copies of one text, half of them too far from any hub: one component or none, with few pairs for each set at either size."""
    r = random.Random(3)
    base, docs, pairs = [f"w{k}" for k in range(150)], {}, {}
    for k in range(n):
        w = list(base)
        for at in r.sample(range(150), 1 if k % 2 else 2):
            w[at] = f"n{k}"
        docs[k] = " ".join(w)
    written = Scratch.table

    def counted(scratch, df, name):
        out = written(scratch, df, name)
        if name.endswith("-pairs"):
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(Scratch, "table", counted)
    got = neardup.components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), Scratch(spark, "t"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(docs)
    assert sum(pairs.values()) < 4 * len(docs), pairs


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies_at_the_pipeline_s_threshold(spark, monkeypatch, small):
    """Copies at 0.836, 0.806 and 0.778 of their source: none links at 85, the first two do in the pipeline's stage."""
    import corpus_pipeline as p

    monkeypatch.setattr(neardup, "SMALL", small)
    docs = {}
    for k in range(0, 40, 4):
        base = [f"a{k}b{i}" for i in range(60)]
        for j, changed in enumerate([(), (30,), (29, 30), (1, 30)]):
            docs[k + j] = " ".join(f"n{j}" if i in changed else w for i, w in enumerate(base))
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {percent: {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(df, Scratch(spark, "t"), percent).collect()} for percent in (80, 85)}
    assert got[80] == brute_components(docs, 80) and got[85] == brute_components(docs) and got[80] != got[85]
    rest = p.drop_near_copies(spark, df, DIR)
    assert sorted(r.doc_id for r in rest.collect()) == sorted(k for k, (_, root) in got[80].items() if k == root)


def test_near_copies_on_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_neardup(spark, DIR).collect()}
    assert got == brute_components(docs)


def test_one_of_each_group_stays(spark, odd, none):
    rest = neardup.dedup(odd, Scratch(spark, "t"))
    assert rest.columns == odd.columns
    assert sorted(str(r.doc_id) for r in rest.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert neardup.dedup(none, Scratch(spark, "t")).count() == 0


def test_toxicity_on_held_out_texts(spark, odd, none):
    r = random.Random(2)

    def text(bad):
        words = ["".join(r.choices(["ta", "re", "ing", "on", "the", "li"], k=r.randrange(1, 4))) for _ in range(150)]
        for _ in range(8 * bad):
            words[r.randrange(150)] = r.choice(["blockhead", "nitwit", "dunderhead"])
        return " ".join(words)

    rows = [(k, text(k % 4 == 0), k % 4 == 0) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {k: y for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    scored = {s.doc_id: s for s in toxicity.with_score(docs, model).collect()}
    assert sum(scored[k].predicted == y for k, y in held.items()) / len(held) > 0.95
    got = toxicity.with_score(odd, model)
    assert got.columns == [*[c for c in odd.columns if c != "score"], "score", "predicted"]
    assert got.count() == odd.count() and toxicity.with_score(none, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.with_score(docs, None).where("predicted = 1").count() == 0


def test_toxicity_never_sees_held_out_labels(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.toxic == b.toxic and a.weights.tolist() == b.weights.tolist()


def test_pipeline(spark):
    import corpus_pipeline as p

    stages, docs = {}, spark.read.parquet(f"{DIR}/documents.parquet")
    for name, f in p.STAGES:
        docs = f(spark, docs, DIR)
        if name != "bpe":
            assert docs.columns == p.COLUMNS
            docs = Scratch(spark, "t").table(docs, name)
        stages[name] = docs
    texts = {r.doc_id: r.text for r in stages["line_dedup"].collect()}
    alone = brute_components(texts, p.NEAR_PERCENT)
    assert {r.doc_id for r in stages["near_dedup"].collect()} == {k for k, (n, root) in alone.items() if k == root}
    assert sorted(r.doc_id for r in stages["mixing"].collect()) == sorted(r.doc_id for r in stages["bpe"].collect())
    assert json.dumps([n for n, _ in p.STAGES]) == json.dumps(["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"])


CLASHES = "source_size target copies copy shard slot block tie size_class bucket extra score predicted _split _kept _lines _dropped _boilerplate _hash _least _on _salt _at _source _doc_id h sig label n"


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_names_that_clash(spark, odd, monkeypatch, rows):
    """All operators that keep columns, broadcasting and, the second time, with shuffle joins alone."""
    from vellum.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    names = [c for c in CLASHES.split() if c not in odd.columns]
    wide = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    mixed = mixing.mix(wide.withColumn("size", mixing.words()))
    assert mixed.count() == odd.count() and mixing.repeat(mixed).where("copy = 3").count() == mixing.repeat(mixed).count()
    rest = neardup.dedup(wide, Scratch(spark, "t"))
    assert rest.columns == wide.columns and rest.count() == neardup.dedup(odd, Scratch(spark, "t")).count()
    assert linededup.drop_lines(wide, "source", Scratch(spark, "t")).count() == odd.count()
    sized = wide.withColumn("size", F.lit(5).cast("long")).withColumn("old_shard", F.lit(0).cast("int"))
    placed = reshard.reshard(sized, 2, 1, Scratch(spark, "t")).collect()
    assert sorted(r.slot for r in placed if r.shard == 0) == list(range(sum(r.shard == 0 for r in placed)))
    assert all(r.tie == names.index("tie") and r.block == names.index("block") for r in placed)


def test_many_null_ids(spark):
    """300 rows without an id: their sets are made once each, and none is lost."""
    rows = [(None, f"a b c d e f g h {k % 100}") for k in range(300)] + [(1, "a b c d e f g h 5"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.components(df, Scratch(spark, "t")).collect()
    assert len(got) == 302 and sum(r.component_id == 1 for r in got) == 4
    assert neardup.dedup(df, Scratch(spark, "t")).count() == 101


def test_pieces_of_spaced_texts():
    """Source code, aligned columns, white space of all kinds: equal to the library, within a fixed memory."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, ours = Tokenizer.from_file(path), bpe.Encoder(bpe.ByteBpe(path))
    r = random.Random(3)
    white = [" ", "  ", "\n", "\n \n", "\t", " \n", "\u00a0", "\u3000", "\u2009 ", "\r\n", "        "]
    texts = ["".join(r.choice(white) + r.choice(["x", "if", "'s", "12", "\u00e9t\u00e9", "\u4e2d", "=", "foo.bar", "w" * 70]) for _ in range(r.randrange(1, 30))) + r.choice(["", *white]) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, counts = ours.encode(part)
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    for k in range(40):
        ours.encode(["\n".join(" " * r.randrange(40) + f"v{r.randrange(10**9)} = {r.random()}" for _ in range(5000)) for _ in range(2)])
        known = ours.known
        assert known.used <= bpe.POOL + 2 * bpe.BATCH_BYTES and sum(x.nbytes for x in (known.hash, known.entry, known.ids, known.at, known.length)) < 200 << 20


def test_word_hashes_know_bytes_alone():
    import pyarrow as pa

    from vellum.llm import words

    texts = ["The cat", None, "", " the  CAT\n", "x" * 600_000, "y " + "x" * 600_000, "a\u00a0b", "a b"]
    hashes, counts = words.word_hashes(pa.array(texts))
    assert counts.tolist() == [2, 0, 0, 2, 1, 2, 1, 2]
    assert hashes[:2].tolist() == hashes[2:4].tolist() and hashes[4] == hashes[6] and len(set(hashes.tolist())) == 7
