"""op4, op7, op8, op9 and the pipeline."""

import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, exact_dedup, jaccard, mixing, quality, queries, transport, url_filter, warc
from tests.compare import oracle, same
from tests.conftest import SF


@pytest.mark.parametrize("n", [0, 1, 150, 161, 162, 163, 169, 175, 176, 177, 345, 346, 360, 61440, 61441, 200000])
def test_transport_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stream = transport.mux(payload)
    found = transport.demux(stream)
    assert found["payload"] == payload and found["intact"] and found["gaps"] == 0
    assert [x["pts"] for x in found["stamps"]] == [k * transport.TICK for k in range(-(-n // transport.UNIT))]
    assert found["random_access"] == [x["packet"] for x in found["stamps"] if x["random_access"]] and len(stream) % 188 == 0
    assert len(found["random_access"]) == len(found["stamps"]) and found["repeats"] == 0


def test_transport_damage():
    stream = bytearray(transport.mux(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()))
    assert not transport.demux(bytes(stream[: 188 * 5] + stream[188 * 6 :]))["intact"]
    stream[188 * 5 + 3] ^= 1
    assert transport.demux(bytes(stream))["gaps"] == 2
    stream[10] ^= 1
    assert not transport.demux(bytes(stream))["intact"]
    assert not transport.demux(b"junk")["intact"]


def test_transport_repeats_and_discontinuity():
    """A packet may be sent twice; a flagged jump of the counter is no gap; a third copy is one."""
    stream = transport.mux(b"x" * 5000)
    packet = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    for k in (2, 5, len(packet) - 1):
        found = transport.demux(b"".join([*packet[: k + 1], *packet[k:]]))
        assert (found["payload"], found["repeats"], found["gaps"], found["intact"]) == (b"x" * 5000, 1, 0, True)
    assert transport.demux(b"".join([*packet[:6], packet[5], *packet[5:]]))["gaps"] == 1
    two = transport.mux(b"y" * 70_000)
    jump = bytearray(two)
    start = transport.demux(two)["stamps"][1]["packet"]
    for k in range(start, len(two) // 188):
        jump[188 * k + 3] = jump[188 * k + 3] & 0xF0 | (jump[188 * k + 3] + 5) & 15
    assert transport.demux(bytes(jump))["gaps"] == 1
    jump[188 * start + 5] |= 0x80
    assert transport.demux(bytes(jump)) == transport.demux(two)


def plain_feature(stream: bytes) -> str:
    """The feature by a plain loop over packets, with the elementary stream's PID as the muxer chose it."""
    pes, stamps, random, gaps, last = [], [], 0, 0, None
    for i in range(0, len(stream), 188):
        p = stream[i : i + 188]
        assert p[0] == 0x47
        if (p[1] & 31) * 256 + p[2] != 0x100:
            continue
        if last is not None and p[3] % 16 != (last + 1) % 16:
            gaps += 1
        last, at = p[3] % 16, 4
        if p[3] & 0x20:
            at = 5 + p[4]
            random += bool(p[4] and p[5] & 0x40)
        if p[1] & 0x40:
            pes.append(b"")
            bits = "".join(f"{b:08b}" for b in p[at + 9 : at + 14])
            stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        pes[-1] += p[at:]
    whole = all(len(x) == 6 + x[4] * 256 + x[5] for x in pes) and not gaps
    return f"packets={len(stream) // 188};pes={len(pes)};last_pts={max(stamps, default=0)};random_access={random};gaps={gaps};intact={str(whole).lower()}"


def test_transport_query(spark):
    got = {r["doc_id"]: r for r in queries.op7_media_ts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = r["text"].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        row = got[r["doc_id"]]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = transport.mux(payload)
        assert (row["media_bytes"], row["media_sha256"], row["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), plain_feature(media))


def test_transport_odd(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "é", 3)], "doc_id long, text string, media int")
    got = transport.digests(docs).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 0, 2] and {r["payload_bytes"] for r in got} == {64}
    assert transport.digests(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a" * 100_000, "x", 5), (1, "a" * 100_000, "x", 5), (2, None, None, None)], "doc_id long, text string, payload string, gaps int")
    read = transport.from_media(transport.to_media(clash)).collect()
    assert read[0].__fields__ == ["doc_id", "text", "media", *transport.NAMES]
    assert sorted((r["doc_id"], len(r["payload"]), len(r["stamps"]), r["gaps"], r["intact"]) for r in read) == [(1, 100_032, 2, 0, True)] * 2 + [(2, 64, 1, 0, True)]
    assert [r["intact"] for r in transport.from_media(spark.createDataFrame([(None,), (b"",)], "media binary")).collect()] == [False, False]


def b32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_query(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op8_warc(spark, SF).collect()}
    rows = [(r["page_id"], r["html"].encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for key, raw in rows:
        last[raw] = max(last.get(raw, key), key)
    assert got == {k: (len(raw), b32(raw), *(("response", None) if last[raw] == k else ("revisit", last[raw]))) for k, raw in rows}


def test_warc_odd(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, None, None), (None, "u", ""), (4, "ü\r\n", "x"), (4, "d", "x"), (9, "c", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, "revisit", 4, b32(b"x")), (2, "revisit", 4, b32(b"x")), (3, "response", None, b32(b"")), (None, "revisit", 3, b32(b"")), (4, "response", None, b32(b"x")), (4, "response", None, b32(b"x")), (9, "response", None, b32(b"WARC/1.1\r\n\r\n"))], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least=100).collect()} == {"response"}


def test_records_need_whole_archive():
    one = warc.record("response", 1, "u", b"abc", None, "p:0", warc.CAPTURED)
    whole = one * 3
    parts = [whole[i : i + 7] for i in range(0, len(whole), 7)]
    assert [raw for _, raw in warc.records(iter(parts))] == [one] * 3
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(iter([whole[:-10]])))


def test_inflate_in_blocks():
    """Blocks are bounded however well the data pack; members may follow one another; a cut stream is an error."""
    raw = b"a" * 5_000_000 + bytes(range(256)) * 100
    packed = gzip.compress(raw) + gzip.compress(b"") + gzip.compress(b"tail")
    blocks = list(warc.inflate(io.BytesIO(packed), 1000))
    assert b"".join(blocks) == raw + b"tail" and max(map(len, blocks)) <= 1000
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = engine.compress(b"whole record") + engine.flush(zlib.Z_FULL_FLUSH)
    for cut in (flushed, packed[:-3], b""):
        with pytest.raises(ValueError, match="gzip member"):
            list(warc.inflate(io.BytesIO(cut), 1000))


def test_warc_members_by_sidecar(spark, tmp_path):
    """Long payloads, repeated rows: records have ids of their own and dates, and the sidecar finds each."""
    rows = [(1, "u", "x" * 3_000_000), (2, "v", "ü" * 1_500_000), (2, "v", "ü" * 1_500_000), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(warc.decide_revisits(pages), f"file://{tmp_path}/whole")
    members = warc.normalise(files, f"file://{tmp_path}/whole", f"file://{tmp_path}/members")
    back = warc.read_archives(members, f"file://{tmp_path}/members").collect()
    assert sorted((r["id"], r["url"] or "", bytes(r["payload"])) for r in back) == sorted((k, u or "", (h or "").encode()) for k, u, h in rows)
    names = []
    for index in tmp_path.glob("members/*.index"):
        packed = index.with_suffix("").read_bytes()
        for line in index.read_text().splitlines():
            at, length, kind, name = line.split()
            found = warc.headers(gzip.decompress(packed[int(at) : int(at) + int(length)]).split(b"\r\n\r\n")[0])
            assert (found["WARC-Type"], found["WARC-Record-ID"]) == (kind, name) and found["WARC-Date"] == warc.CAPTURED
            names.append(name)
    assert len(names) == len(set(names)) == 4


def test_url_filter_oracle(spark):
    same(queries.op9_url_filter(spark, SF).toPandas(), oracle(SF, queries.ORACLES["op9_url_filter"]))


def test_url_filter_intervals(spark):
    changes = [("l", "host", "a.com", "2024-01-10", "add"), ("l", "host", "a.com", "2024-01-12", "add"), ("l", "host", "a.com", "2024-01-20", "remove"), ("l", "host", "a.com", "2024-02-01", "add"), ("l", "host", "a.com", "2024-02-01", "remove"), ("m", "suffix", "b.org", "2024-01-05", "add"), ("m", "path", "c.net/x", "2024-01-05", "add"), ("m", "host", None, "2024-01-05", "add")]
    changes = spark.createDataFrame(changes, "list string, kind string, key string, on string, action string").withColumn("on", F.to_date("on"))
    seen = [(1, "http://A.com/p", "2024-01-09"), (2, "http://a.com", "2024-01-10"), (3, "http://a.com", "2024-01-19"), (4, "http://a.com", "2024-01-20"), (5, "https://u:p@x.y.b.org:80/q", "2024-03-01"), (6, "http://b.org/", "2024-03-01"), (7, "http://c.net/x/y?z", "2024-03-01"), (8, None, "2024-03-01"), (9, "junk", "2024-03-01"), (10, "http://a.com", None), (3, "http://a.com", "2024-01-19")]
    captures = spark.createDataFrame(seen, "page_id long, url string, at string").select("page_id", "url", F.to_date("at").alias("at"), F.lit(1).alias("key"))
    got = sorted((r["page_id"], r["blocked"], r["lists"]) for r in url_filter.judge(captures, changes, "page_id", "url", "at").collect())
    assert got == [(1, False, ""), (2, True, "l"), (3, True, "l"), (3, True, "l"), (4, False, ""), (5, True, "m"), (6, False, ""), (7, True, "m"), (8, False, ""), (9, False, ""), (10, False, "")]
    assert url_filter.judge(captures.limit(0), changes, "page_id", "url", "at").count() == 0
    assert not any(r["blocked"] for r in url_filter.judge(captures, changes.limit(0), "page_id", "url", "at").collect())


def test_mixing_oracle(spark):
    same(queries.op4_source_mixing(spark, SF).toPandas(), oracle(SF, queries.ORACLES["op4_source_mixing"]))


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "d string, s string, capacity long")
    got = mixing.allocate(leaves, ["d", "s"], {"d": F.lit(1), "s": F.lit(1)}, F.lit(200))
    assert {(r["d"], r["s"]): r["budget"] for r in got.collect()} == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    got = mixing.allocate(leaves, ["d", "s"], {"d": F.lit(1), "s": F.lit(1)}, F.lit(10_000))
    assert {r["budget"] for r in got.collect()} == {10, 1000}


def test_mixing_odd(spark):
    rows = [(1, "a b", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "c d e", "en", "s2"), (1, "a b", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit(1))
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 5 and sum(r["n_tokens"] * r["copies"] for r in got) <= 7
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.keep_mixed(docs).columns == docs.columns


def test_mixing_takes_a_seeded_prefix(spark):
    """Against a plain loop: each leaf takes rows in the order of their hashes until its budget would be passed."""
    rows = [(i, " ".join(["w"] * (i % 7)), "en", f"s{i % 3 * (i % 2)}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"_cut": F.lit(1), "_row": F.lit("x")}).repartition(5)
    got = {r["doc_id"]: (r["copies"], r["leaf_budget"]) for r in mixing.mix_documents(docs, (1, 2), 1).collect()}
    leaves = {}
    for i, text, _, source in rows:
        leaves.setdefault(source, []).append((hashlib.md5(f"1:0:{i}".encode()).hexdigest()[:15], i, len(text.split())))
    taken = set()
    for source, members in leaves.items():
        budget, used = got[members[0][1]][1], 0
        if budget == sum(n for *_, n in members):
            continue  # whole epochs have no prefix
        for _, i, n in sorted(members):
            if used + n > budget:
                break
            used += n
            taken |= {i} if n else set()
        assert used > budget - 7
        assert {i for _, i, _ in members if got[i][0]} == taken & {i for _, i, _ in members}
    kept = mixing.keep_mixed(docs, (1, 2), 1)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (c, _) in got.items() if c)



def test_pipeline_stage_by_stage(spark):
    """Each stage against its operator's own verdict on the stage's input; the operators are tested against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SF).cache()
    verdict = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, p in verdict.items() if p}
    single = stages["exact_dedup"](spark, good, SF).cache()
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in exact_dedup.exact_dedup(good).filter("kept").collect()}
    near = stages["ngram_jaccard"](spark, single, SF).cache()
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in jaccard.jaccard_components(single, width=5, low=80).collect()}
    mixed = stages["source_mixing"](spark, near, SF).cache()
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix_documents(near, (9, 10), 1).filter("copies > 0").collect()}
    for stage in (good, single, near, mixed):
        assert stage.columns == docs.columns
    assert 0 < mixed.count() < near.count() <= single.count() < good.count() <= docs.count()
    coded = stages["bpe_encode"](spark, mixed, SF)
    texts = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in coded.collect()} == texts


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
