"""Operators 1 to 10 against brute force, on whole small tables and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SF, rows_of

from shapewright.llm import chat, langid, media, mixing, packing, pii, quality, queries, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"mot{i % 977} wort{i % 31}" for i in range(15_000))
EDGE = [
    (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "The the THE the", None, None, 4), (2, "The the THE the", None, None, 4), (None, "null key here", "en", "a", 3),
    (4, LONG, "en", "b", len(LONG)), (5, "a b c a b c a b c\n\nx y\nx y", "fr", "a", 9), (6, "écrivez à o'neil@ex-ample.co.uk ou 4111 1111 1111 1111!", "fr", "b", 9),
    (7, "😀 \x0b\x1c tab\tİstanbul ΣΑΣ <|endoftext|> it's 12 34", "en", "b", 9), (8, "12 !! ##", "de", "a", 9), (9, "the the the the", "en", "a", 4),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows_of(queries.queries()[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.oracle_sql()[name]).df())


OPERATORS = {
    "op1": media.media_digests, "op3": quality.judged_documents, "op4": mixing.mixed_documents, "op5": langid.identified_documents, "op7": packing.packed_documents,
    "op8": simhash.near_documents, "op9": pii.pii_digests,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges_and_empty(spark, edge, name):
    out = OPERATORS[name](edge).collect()
    if name not in ("op4", "op7"):
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in EDGE)
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_clashing_columns(spark, edge):
    from pyspark.sql import functions as F

    more = edge.withColumns({"media": F.lit(1), "score": F.lit("x"), "pii": F.lit(2), "copy_no": F.lit(3), "fp": F.lit(4)})
    assert dict(media.telephony(more).dtypes)["media"] == "binary"
    assert dict(pii.find_pii(more).dtypes)["fp"] == "int" and dict(mixing.mix(more).dtypes)["copy_no"] == "int"
    assert langid.identify(more, langid.fit(more)).count() == len(EDGE)
    assert simhash.near_components(more).count() == len(EDGE) and quality.judge(more).count() == len(EDGE)


def test_media(spark, docs, texts, edge):
    for frame, rows in ((docs, texts), (edge, [r[:2] for r in EDGE])):
        got = Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media_digests(frame).collect())
        want = Counter()
        for _, t in rows:
            raw = (t or "").encode()
            p = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
            want[len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
        assert got == want


def test_codec_tables():
    """All codes against the segments of G.711, which double their steps."""
    for code in range(256):
        mu = code ^ 0xFF
        want = ((2 * (mu & 15) + 33) << (mu >> 4 & 7)) - 33
        assert media.EXPAND["mulaw"][code] == 4 * want * (-1 if mu & 128 else 1)
        a = code ^ 0x55
        e, m = a >> 4 & 7, a & 15
        want = 2 * m + 1 if e == 0 else (2 * m + 33) << (e - 1)
        assert media.EXPAND["alaw"][code] == 8 * want * (1 if a & 128 else -1)


def slow_media(payload, codec):
    """A WAVE file, its samples and its feature, sample by sample."""
    import struct

    if codec == "ima":
        sound = []
        for at in range(0, len(payload), 36):
            block = payload[at : at + 36]
            p, i = struct.unpack("<h", block[:2])[0], min(block[2], 88)
            sound.append(p)
            for n in (x for b in block[4:] for x in (b & 15, b >> 4)):
                step = media.STEP_SIZES[i]
                d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                p = max(-32768, min(32767, p - d if n & 8 else p + d))
                i = max(0, min(88, i + media.INDEX_STEPS[n & 7]))
                sound.append(p)
    else:
        sound = [int(media.EXPAND[codec][b]) for b in payload]
    tag, rate, unit, bits, extra = {"ima": (17, 8000 * 36 // 65, 36, 4, struct.pack("<HH", 2, 65)), "mulaw": (7, 8000, 1, 8, b"\0\0"), "alaw": (6, 8000, 1, 8, b"\0\0")}[codec]
    layout = struct.pack("<HHIIHH", tag, 1, 8000, rate, unit, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(layout)) + layout + b"fact" + struct.pack("<II", 4, len(sound)) + b"data" + struct.pack("<I", len(payload)) + payload
    changes = sum((x < 0) != (y < 0) for x, y in zip(sound, sound[1:], strict=False))
    feature = f"{codec};n={len(sound)};peak={max(map(abs, sound))};ms={sum(x * x for x in sound) // len(sound)};zc={changes};full={sum(abs(x) >= 32124 for x in sound)}"
    return b"RIFF" + struct.pack("<I", len(body)) + body, sound, feature


@pytest.mark.parametrize("codec", [None, *media.CODECS])
def test_media_files_and_features(monkeypatch, codec):
    texts = ["", None, "short", "long é " * 3000, "The the", "x" * 576, LONG[:20000]]
    want = media.transcode(texts, codec)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        kind = codec or media.CODECS[zlib.crc32(payload) % 3]
        file, sound, feature = slow_media(payload, kind)
        assert (want[0][i].as_py(), want[1][i].as_py(), want[3][i].as_py(), want[4][i].as_py()) == (file, payload, kind, feature)
        _, rate, pcm = media.read_wave(want[2][i].as_py())
        heard = np.frombuffer(pcm, "<i2")
        assert rate == 16000 and heard[::2].tolist() == sound and len(heard) == 2 * len(sound)
    monkeypatch.setattr(media, "PART", 576)  # every file longer than a unit goes in parts
    assert [x.to_pylist() for x in media.transcode(texts, codec)] == [x.to_pylist() for x in want]


@pytest.mark.parametrize("target", [4000, 11025, 16000, 8000])
def test_resampling_in_parts(monkeypatch, target):
    sound = np.random.default_rng(7).integers(-32768, 32768, 9001).astype(np.int16)
    want = media.resample(sound, 8000, target)
    monkeypatch.setattr(media, "PART", 100)
    for size in (1, 7, 333, 5000):
        got = np.concatenate(list(media.resampled([sound[i : i + size] for i in range(0, len(sound), size)], 8000, target)))
        assert (got == want).all() and len(got) == -(-len(sound) * target // 8000)


def test_media_of_a_long_text_in_bounded_memory(tmp_path):
    """50 MB of text as ADPCM, whose PCM has 361 MB, in under 1 GB of a process."""
    import os
    import subprocess
    import sys

    run = "import resource; from shapewright.llm import media; media.transcode(['long text ' * 5_000_000], 'ima'); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", run], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout.split()[-1]) < 1_000_000


def test_ima_block_against_a_loop():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, media.BLOCK), dtype=np.uint8)
    for row, got in zip(blocks, media.decode_ima(blocks), strict=True):
        p, i = int(np.frombuffer(row[:2].tobytes(), "<i2")[0]), min(int(row[2]), 88)
        want = [p]
        for b in row[4:]:
            for n in (int(b) & 15, int(b) >> 4):
                step = media.STEP_SIZES[i]
                d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                p = max(-32768, min(32767, p - d if n & 8 else p + d))
                i = max(0, min(88, i + media.INDEX_STEPS[n & 7]))
                want.append(p)
        assert got.tolist() == want


def test_resample_keeps_samples_and_constants():
    x = np.full(200, 1000, np.int16)
    y = media.resample(x, 8000, 16000)
    assert len(y) == 400 and (y[::2] == 1000).all() and abs(int(y[201]) - 1000) <= 2
    assert len(media.resample(x, 8000, 11025)) == -(-200 * 11025 // 8000) and len(media.resample(x, 8000, 4000)) == 100


def url_index(spark, path, hosts, rules=urls.RULES, digested=None, range_bytes=urls.RANGE_BYTES):
    keys = urls.keys_of(spark.createDataFrame(list(rules), "host string, path string, verdict string"), hosts)
    return urls.Index(urls.write_index(spark, path, keys, digested, range_bytes), lambda name: f"{path}/{name}")


@pytest.mark.parametrize("range_bytes", [40, 1 << 20])
def test_url_collisions_are_confirmed(spark, tmp_path, range_bytes):
    from pyspark.sql import functions as F

    index = url_index(spark, str(tmp_path / "i"), spark.createDataFrame([("bad.com",)], "host string"), digested=F.lit(7).cast("long"), range_bytes=range_bytes)
    found = index.probe([b"com/en/", b"nothing", b"bad.com", b"com"], digest=lambda key: 7)
    assert sorted(found) == [0, 2, 3] and found[0][:2] == (urls.BLOCK, 3) and found[2][0] == urls.LISTED and found[3][0] == 0 and found[3][2].tolist() == [4]


def test_url_index_holds_a_large_list(spark, tmp_path):
    """Two million hosts, written by the executors in ranges; the driver sees their names and bounds."""
    hosts = spark.range(2_400_000).selectExpr("concat('h', id % 2000000, '.example.org') AS host")
    index = url_index(spark, str(tmp_path / "i"), hosts, range_bytes=20 << 20)
    assert 4 < len(index.ranges) < 12
    sizes = [len(urls.Range(f"{tmp_path}/i/{r[0]}").digests) for r in index.ranges]
    assert sum(sizes) == 2_000_000 + 5 + 5 and max(sizes) < 3 * min(sizes)
    assert all(a[2] <= b[1] for a, b in zip(index.ranges, index.ranges[1:], strict=False))
    keys = [f"h{i}.example.org".encode() for i in range(1_990_000, 2_010_000)]
    found = index.probe(keys)
    assert sorted(found) == list(range(10_000)) and {v[0] for v in found.values()} == {urls.LISTED}
    assert index.judge(["a.h7.example.org", "h2000000.example.org", "xh7.example.org"], ["/", "/", "/"])[1] == ["block", "allow", "allow"]


def test_url_index_of_unbounded_size_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "LARGEST_INDEX", 1000)
    with pytest.raises(ValueError, match="disks"):
        url_index(spark, str(tmp_path / "i"), spark.range(100).selectExpr("concat('h', id) AS host"))


def test_url_host_of_many_rules(spark, tmp_path):
    """A host with very many paths: a url looks up as many keys as its host has lengths of path."""
    rules = [("big.com", f"/{i:05d}/", "block") for i in range(20_000)] + [("big.com", "/00007/a/", "allow"), ("big.com", "", "allow"), ("w.big.com", "/00007/", "allow")]
    index = url_index(spark, str(tmp_path / "i"), spark.createDataFrame([], "host string"), rules, range_bytes=100_000)
    hosts = ["big.com", "x.big.com", "big.com", "w.big.com", "notbig.com", "big.com"]
    paths = ["/00007/", "/00007/a/b", "/nothing", "/00007/", "/00007/", "/19999/x"]
    assert index.judge(hosts, paths) == (["big.com/00007/", "big.com/00007/a/", "big.com", "w.big.com/00007/", None, "big.com/19999/"], ["block", "allow", "allow", "allow", "allow", "block"])


def slow_urls(rows, listed):
    out = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        blocked = any(host == h or host.endswith("." + h) for h in listed)
        out.append((i, host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "block" if blocked else "allow"))
    return sorted(map(str, out))


def test_url_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7x?y"), (4, "x://example.com/en/6"), (5, "x://notcom/en/"), (6, "x://spam-farm.example.org"), (7, "x://?a/en/")]
    rows += [(8, "x://www.spam-farm.example.com/en/7"), (8, "x://www.spam-farm.example.com/en/7"), (9, "x://a.b.spam-farm.example.org#"), (10, "x://h/" + "é" * 100_000), (11, "://É.Com/en/"), (None, "x://casino.net/de/8"), (12, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    out = [tuple(r) for r in urls.judged_pages(frame).collect()]
    assert sorted(map(str, out)) == slow_urls(rows, {"spam-farm.example.org", "www.spam-farm.example.com", "a.b.spam-farm.example.org", "casino.net"})
    more = frame.withColumns({"Host": F.lit(1), "verdict": F.lit(2), "c0": F.lit(3), "a.b": F.lit(4)})
    got = urls.filter_urls(more)
    assert got.columns == ["page_id", "url", "c0", "a.b", "host", "path", "rule", "verdict"] and got.count() == len(rows) and {r["a.b"] for r in got.collect()} == {4}
    assert urls.judged_pages(frame.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule's word by itself, written out here: by the operator on listed and other hosts, and in the SQL."""
    import duckdb

    contract = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert sorted(urls.RULES) == sorted(contract)
    want = [(10 * i + j, h + p, v) for i, (h, p, v) in enumerate(contract) for j in range(3)]
    asked = [f"x://{sub}{h}{p}" for h, p, _ in contract for sub in ("", "a.", "casino.")]
    frame = spark.createDataFrame([(k, u) for (k, *_), u in zip(want, asked, strict=True)], "page_id long, url string")
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.judged_pages(frame).collect()) == want
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [list(r) for r in frame.collect()])
    assert sorted(con.execute(f"select page_id, rule, verdict from ({urls.ORACLE_SQL})").fetchall()) == want


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len({j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)})


def test_quality_counts(spark, docs, texts, edge):
    for frame, rows in ((docs, texts), (edge, [r[:2] for r in EDGE])):
        got = Counter(tuple(r)[:7] for r in quality.judged_documents(frame).collect())
        want = Counter((i, *(c := base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows)
        assert got == want


def test_mcd_rejects_planted_outliers(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "word", "text", "line"]
    rows = [(i, " ".join(rng.choice(words) + str(rng.integers(999)) for _ in range(rng.integers(60, 200))), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words) + str(rng.integers(999)) + "###" for _ in range(100)), "en", "s", 0) for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(kept[i] for i in range(200)) >= 198 and not any(kept[1000 + i] for i in range(20))
    assert {r["doc_id"]: r["kept"] for r in quality.judged_documents(spark.createDataFrame(rows[::-1], DOCS)).collect()} == kept


def slow_mcd(rows):
    """d2 by doc_id of rows (doc_id, lang, source, x): the whole estimate in numpy."""
    q = quality
    ids, langs, sources = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
    x = np.array([r[3] for r in rows])
    pools = {("*",): (None, np.arange(len(rows)))}
    for k in sorted({(a,) for a in map(str, langs)}):
        pools["L", *k] = (("*",), np.array([i for i, a in enumerate(langs) if str(a) == k[0]]))
    for k in sorted({(str(a), str(b)) for a, b in zip(langs, sources, strict=True)}):
        pools["S", *k] = (("L", k[0]), np.array([i for i in range(len(rows)) if (str(langs[i]), str(sources[i])) == k]))
    first_bin = lambda bins, p: next(b for b in np.unique(bins) if (bins <= b).sum() >= p * len(bins))

    def estimates(chosen, scale):
        raw, out = {}, {}
        for k, (parent, _) in pools.items():
            s = x[chosen[k]]
            n, m, c = len(s), s.sum(axis=0) / max(1, len(s)), s.T @ s / max(1, len(s))
            if parent:
                m, c = (n * m + q.PRIOR * raw[parent][0]) / (n + q.PRIOR), (n * c + q.PRIOR * raw[parent][1]) / (n + q.PRIOR)
            raw[k] = m, c
            out[k] = m, scale * (c - np.outer(m, m)) + np.diag(np.square(q.FLOOR))
        return out

    def d2_of(k, e):
        z = x[pools[k][1]] - e[k][0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(e[k][1]), z)

    def nearest(d2):
        bins = np.floor(q.OCTAVE * np.log2(np.maximum(d2, 1e-9)))
        return bins <= first_bin(bins, q.H)

    found = []
    for start in (0, 1):
        chosen = {}
        for k, (_, own) in pools.items():
            at = [(np.percentile(np.floor(x[own, j] * q.FINE), (25, 50, 75)) + 0.5) / q.FINE for j in range(q.DIM)]
            z = np.stack([(x[own, j] - at[j][1]) / max((at[j][2] - at[j][0]) / 1.349, q.FLOOR[j]) for j in range(q.DIM)], axis=1)
            chosen[k] = own[nearest((z * z).sum(axis=1) if start == 0 else np.abs(z).max(axis=1))]
        found.append([estimates(chosen, q.CONSISTENCY)])
    dets = lambda: {(s, k): np.linalg.slogdet(f[-1][k][1])[1] for s, f in enumerate(found) for k in pools}
    for _ in range(q.MOST_STEPS - 1):
        was = dets()
        for f in found:
            f.append(estimates({k: pools[k][1][nearest(d2_of(k, f[-1]))] for k in pools}, q.CONSISTENCY))
        if max(abs(v - was[k]) for k, v in dets().items()) < q.STEADY:
            break
    now = dets()
    best = {k: found[0 if now[0, k] <= now[1, k] else 1][-1][k] for k in pools}
    last = estimates({k: pools[k][1][d2_of(k, best) <= q.REWEIGHT] for k in pools}, 0.975 / q.chi2(q.REWEIGHT, q.DIM + 2))
    return {ids[i]: d for k in pools if k[0] == "S" for i, d in zip(pools[k][1], d2_of(k, last), strict=True)}


def test_mcd_equals_a_plain_one(spark, docs):
    out = quality.judge(docs).where("NOT base_failed").join(docs.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", *quality.statistics().values(), "d2", "kept").collect()
    assert len({r["source"] for r in out}) > 5 and min(Counter((r["lang"], r["source"]) for r in out).values()) < 3
    want = slow_mcd([(r[0], r[1], r[2], list(r)[3 : 3 + quality.DIM]) for r in out])
    assert all(r["d2"] == pytest.approx(want[r["doc_id"]], rel=1e-6, abs=1e-9) and r["kept"] == (want[r["doc_id"]] <= quality.CUTOFF) for r in out)


def known_groups(spark, sizes, shift=0.0):
    """Rows of estimate(): a language's sources with one known covariance and means of their own, an eighth of each far away."""
    rng = np.random.default_rng(11)
    root = np.array([[0.5, 0, 0, 0], [0.2, 0.4, 0, 0], [-0.1, 0.1, 0.5, 0], [0.1, 0.2, -0.1, 0.6]])
    rows, x = [], {}
    for g, n in sizes.items():
        own = rng.normal(size=(n, 4)) @ root.T + shift * rng.normal(size=4)
        own[: n // 8] += 12
        x[g] = own
        for level, name, parent in ((0, "*", ""), (1, "L", "*"), (2, g, "L")):
            rows += [(name, level, parent, i % quality.SALTS, *map(float, v)) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, level int, parent string, salt int, x0 double, x1 double, x2 double, x3 double")
    out = {}
    for r in quality.estimate(df, True).collect():
        low = np.array([[r[f"l_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        out[r["g"]] = np.array([r[f"m_{a}"] for a in quality.STATS]), low @ low.T
    return x, out, root @ root.T


def unshrunk(x):
    """A group's own minimum covariance determinant: the best of many starts, concentrated and reweighted, nothing borrowed."""
    rng, best = np.random.default_rng(0), None
    n, h = len(x), int(np.ceil(quality.H * len(x)))
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(60):
        own = x[rng.choice(n, 6, replace=False)]
        m, c = own.mean(axis=0), np.cov(own.T) + 1e-6 * np.eye(4)
        for _ in range(20):
            own = x[np.argsort(d2(m, c))[:h]]
            m, c = own.mean(axis=0), np.cov(own.T, bias=True)
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, quality.CONSISTENCY * c
    own = x[d2(*best[1:]) <= quality.REWEIGHT]
    return own.mean(axis=0), np.cov(own.T, bias=True) * 0.975 / quality.chi2(quality.REWEIGHT, 6)


def test_large_groups_are_estimated_as_without_their_prior(spark):
    """A group of 4,000 rows has the location and scatter of an estimate that borrows nothing, and those that are known."""
    x, out, truth = known_groups(spark, {"L/a": 4000, "L/b": 4000})
    floor = np.diag(np.square(quality.FLOOR))
    for g in x:
        m, c = unshrunk(x[g])
        assert np.abs(out[g][0] - m).max() < 0.02 and np.abs(out[g][1] - floor - c).max() < 0.02
        assert np.abs(out[g][0]).max() < 0.04 and np.abs(out[g][1] - floor - truth).max() < 0.04


def test_small_groups_lean_on_their_language(spark):
    """What PRIOR does: of a group of 10 rows far from its language's others the location moves most of the way to theirs, of 400 hardly."""
    sizes = {"L/big": 3000, "L/ten": 10, "L/four": 400}
    x, out, _ = known_groups(spark, sizes, shift=1.0)
    center = lambda g: x[g][len(x[g]) // 8 :].mean(axis=0)
    moved = {g: np.linalg.norm(out[g][0] - center(g)) / np.linalg.norm(center("L/big") - center(g)) for g in ("L/ten", "L/four")}
    assert 0.5 < moved["L/ten"] < 1.0 and moved["L/four"] < 0.25


def test_repeated_windows_beside_alike_hashes(spark):
    words = " ".join(f"w{i}" for i in range(4000)) + " w7 w8 w9 w10"
    row = quality.judged_documents(spark.createDataFrame([(1, words, "en", "s", 0)], DOCS)).first()
    assert tuple(row)[:6] == (1, *base_counts(words))


def test_mcd_many_groups_join_as_few(spark, docs, monkeypatch):
    rows = lambda: sorted(tuple(r)[:8] for r in quality.judged_documents(docs).collect())
    few = rows()
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    assert rows() == few


def test_chi2():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and quality.chi2_quantile(0.5, 6) == pytest.approx(5.3481, abs=1e-3)


def test_large_rates_and_weights(spark):
    rows = [(i, "t", "en", "big" if i else "one", 1) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), weights={"one": 1.0, "big": 3.0}).groupBy("source").count().collect()
    n = {r[0]: r[1] for r in out}
    assert 400 < n["one"] < 600 and 1400 < n["big"] < 1600


def slow_mix(rows, weights, seed=42):
    """Counts of copies by id, each drawn by walking up the Poisson distribution."""
    from math import exp

    sizes, out = Counter(r[3] for r in rows), {}
    for r in rows:
        rate = len(rows) * weights.get(r[3], 0.0) / sum(weights.get(s, 0.0) for s in sizes) / sizes[r[3]]
        parts, n = max(1, -int(-rate // 64)), 0
        for j in range(1, parts + 1):
            u, k, p = int(hashlib.md5(f"{seed}:{r[0]}:{j}".encode()).hexdigest()[:13], 16) / 2**52, 0, exp(-rate / parts)
            cdf = p
            while cdf <= u and p > 0:
                k += 1
                p *= rate / parts / k
                cdf += p
            n += k
        out[r[0]] = n
    return out


def test_mix_equals_plain_draws_with_many_weights(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 40}" if i % 41 else None, 1) for i in range(800)]
    weights = {f"s{i}": 1.0 + i % 7 for i in range(3, 3003)} | {None: 2.0}
    out = Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights).collect())
    assert out == Counter({k: n for k, n in slow_mix(rows, weights).items() if n})


def test_mix_of_rows_without_ids_and_odd_columns(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(None, f"t{i}", "en", "s", 1) for i in range(300)], DOCS).withColumns({"a.b": F.lit(1), "_mix_n": F.lit(2), "MIX_KEY": F.lit("x")})
    out = mixing.mix(frame)
    rows = out.collect()
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "a.b", "_mix_n", "copy_no", "mix_key"]
    assert 200 < len(rows) < 400 and len(set(Counter(r["text"] for r in rows).values())) > 1 and {r["a.b"] for r in rows} == {1}


def test_many_sources_join_as_few(spark, docs, edge, monkeypatch):
    rows = lambda: sorted(map(str, mixing.mix(docs.unionByName(edge)).collect()))
    few = rows()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert rows() == few


def test_language_accuracy(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = langid.identified_documents(docs).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_presence_kernel_matches_sets():
    a, b = "abcab", "bcabd"
    rows = np.zeros((2, langid.WIDTH), np.float32)
    langid.mark(a, rows[0])
    langid.mark(b, rows[1])
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    want = np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)])
    k = langid.scale(rows)
    assert float(k[0] @ k[1]) == pytest.approx(want, abs=1e-5)


def test_ridge_equals_a_plain_one():
    """Kernel by sets, Nystroem features by an eigendecomposition, weighted ridge in plain numpy."""
    rng = np.random.default_rng(4)
    syllables = {"aa": ["bo", "ri", "ta", "lem"], "bb": ["sch", "ung", "ver", "ta"], "cc": ["ção", "bo", "que"]}
    labels = [x for x in syllables for _ in range(40 if x == "aa" else 25)]
    texts = [" ".join("".join(rng.choice(syllables[x], 2)) for _ in range(12)) for x in labels]

    def grams(t):
        b = t.lower().encode()
        two = {((b[i] << 8 | b[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 20 for i in range(len(b) - 1)}
        three = {(((b[i] << 8 | b[i + 1]) << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2)}
        return set(b), two, three

    kernel = lambda x, y: sum(len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(grams(x), grams(y), strict=True)) / 3
    share = langid.LANDMARKS // 3
    marks = [t for x in sorted(syllables) for t in [t for t, y in zip(texts, labels, strict=True) if y == x][:share]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values[-1]
    features = lambda rows: np.array([[kernel(t, m) for m in marks] for t in rows]) @ (vectors[:, good] / np.sqrt(values[good]))
    z, w = features(texts), np.array([len(labels) / 3 / labels.count(x) for x in labels])
    y = np.array([[1.0 if x == c else -1.0 for c in sorted(syllables)] for x in labels])
    bias = (w[:, None] * y).sum(axis=0) / w.sum()
    ridge = np.linalg.solve((z * w[:, None]).T @ z + langid.RIDGE * len(labels) * np.eye(z.shape[1]), (z * w[:, None]).T @ (y - bias))
    new = ["bori talem riri", "verung schta", "queção bo", "lem ung que"]
    want = features(new) @ ridge + bias
    rows = np.zeros((len(texts), langid.WIDTH), np.uint8)
    for t, row in zip(texts, rows, strict=True):
        langid.mark(t, row)
    model = langid.fit_model([np.packbits(r).tobytes() for r in rows], labels)
    got, scores, likeness = model.predict(new)
    best = want.argmax(axis=1)
    assert got == [sorted(syllables)[i] for i in best]
    odds = np.exp(langid.SHARPNESS * want)
    assert scores == pytest.approx((odds.max(axis=1) / odds.sum(axis=1)).tolist(), abs=2e-3)
    assert likeness == pytest.approx([(v[i] - bias[i]) / (1 - bias[i]) for v, i in zip(want, best, strict=True)], abs=2e-3)


OTHERS = ["Это русский текст о погоде, который модель никогда не видела", "Η γλώσσα αυτή δεν είναι γνωστή στο μοντέλο", "これは日本語の文章です。モデルは学習していません", "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt aikaisemmin eikä tunne"]


def test_unlearned_languages_go_and_learned_ones_stay(spark, docs):
    from pyspark.sql import functions as F

    new = spark.createDataFrame([(10**6 + i, t, "xx", "s", 1) for i, t in enumerate([*OTHERS, "½ ²", "", None])], DOCS)
    held = new.withColumn("lang", F.lit(None).cast("string"))
    frame = docs.unionByName(held).withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "told": F.lit(2), "a.b": F.lit(3)})
    out = langid.keep_known(frame)
    ids = {r["doc_id"] for r in out.collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert out.columns == frame.columns and ids == lettered
    assert {r["lang_pred"] for r in langid.identified_documents(docs.unionByName(held)).where("doc_id = 1000004").collect()} == {"und"}


def test_undetermined(spark, edge):
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identified_documents(edge).collect()}
    assert out[0] == out[1] == out[8] == "und" and out[9] != "und"


def test_chat_snapshots(spark):
    t = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, None, "a"), (5, 0, "user", None), (5, 0, "user", None), (None, 0, "user", "<|im_end|>")]
    out = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.render_chats(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 4, 5, None} and out[2][:2] == (2, 2) and out[5][0] == 2 and out[None][2] == "<|im_start|>user\n<im_end><|im_end|>\n"


def slow_chats(turns):
    by = defaultdict(list)
    digest = lambda role, text: hashlib.md5("".join("-" if x is None else f"={len(x.encode())}:{x}" for x in (role, text)).encode()).hexdigest()
    for n, (c, turn, role, text) in enumerate(turns):
        by[("c", c) if c is not None else ("r", n)].append(((turn is not None, turn or 0), digest(role, text), role, text))
    chats = {k: [x[1:] for x in sorted(v, key=lambda x: x[:2])] for k, v in by.items()}
    keys = {k: tuple(x[0] for x in v) for k, v in chats.items()}
    inner = {v[:n] for v in keys.values() for n in range(1, len(v))}
    out = []
    for whole in set(keys.values()) - inner:
        same = [k for k, v in keys.items() if v == whole]
        ids = [k[1] for k in same if k[0] == "c"]
        clean = lambda t: (t or "").replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>")
        out.append((min(ids) if ids else None, len(whole), len(same), "".join(f"<|im_start|>{clean('user' if r is None else r)}\n{clean(t)}<|im_end|>\n" for _, r, t in chats[same[0]])))
    return sorted(map(str, out))


def test_chat_edges(spark, duck):
    from pyspark.sql import functions as F

    schema = "conv_id long, turn long, role string, text string"
    turns = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 3, "bot", "alone"), (None, None, None, None), (1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "bot", "alone")]
    turns += [(3, None, "user", LONG), (3, None, "user", LONG), (3, 1, None, ""), (4, 1, "user", None), (4, 1, "", "<|im_start|>")]
    turns += [(5, i, "user", f"turn {i % 7}") for i in range(3000)] + [(6, i, "user", f"turn {i % 7}") for i in range(2999)]
    frame = spark.createDataFrame(turns, schema)
    more = frame.withColumns({"d": F.lit(1), "k": F.lit(2), "a": F.lit(3), "n_copies": F.lit("x"), "x.y": F.lit(4)})
    for f in (frame, more):
        assert sorted(str(tuple(r)) for r in chat.render_chats(f).collect()) == slow_chats(turns)
    assert chat.render_chats(frame.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows_of(con.execute(chat.ORACLE_SQL).df()) == rows_of(chat.render_chats(frame).toPandas())


def test_packing(spark, docs, texts, edge):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    for frame, rows in ((docs, texts), (edge, [r[:2] for r in EDGE])):
        out = packing.pack(frame).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in out:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
            assert len(r["ids"]) == 4 * r["length"] > 0
        want = defaultdict(list)
        for i, t in rows:
            want[i].append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        for i, encoded in want.items():
            parts = sorted(by_doc[i], key=lambda r: r["start"])
            assert sum(map(len, encoded)) == sum(len(r["ids"]) for r in parts)
            if len(encoded) == 1:
                assert b"".join(r["ids"] for r in parts) == encoded[0] and {r["doc_tokens"] for r in parts} == {len(encoded[0]) // 4}
        lost = 0
        for parts in by_sequence.values():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= packing.CAPACITY
            lost += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        assert lost < 0.02 * sum(r["length"] for r in out)


def test_open_bins_are_bounded():
    packer = packing.Packer()
    for i in range(400):
        for *_, x, _, _ in packer.add(i, b"\0\0\0\0" * (1 + 997 * i % 9000)):
            assert 0 < len(x) <= 4 * packing.CAPACITY
        assert all(len(bin_) < j and all(len(x) <= 4 * (packing.CAPACITY // j) for *_, x in bin_) for j, bin_ in packer.open.items())
        held = [x for bin_ in packer.open.values() for *_, x in bin_] + [x for *_, x in packer.tail]
        assert sum(map(len, held)) <= 4 * packing.CAPACITY * (packing.LAST + 1)


@pytest.mark.parametrize("capacity,last", [(64, 8), (37, 5), (4096, 64), (16, 16)])
def test_bins_take_whole_documents(capacity, last):
    """Whole documents of a class, a bin of class j with exactly j; gaps filled, a document or none cut for each sequence."""
    rng = np.random.default_rng(capacity)
    sizes = [int(x) for x in np.concatenate((rng.integers(1, capacity, 600), rng.integers(1, 4 * capacity, 60), [capacity, capacity - 1, 1, 1]))]
    packer, out = packing.Packer(5, capacity, last), []
    for i, n in enumerate(sizes):
        out += packer.add(i, np.arange(n, dtype="<u4").tobytes())
        assert not packer.held or capacity - packer.held_size >= packing.LEAST_GAP
    out += packer.close()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, b, x, s, at in out:
        by_doc[d].append((b, x))
        by_sequence[s].append((at, len(x) // 4, d))
    for i, n in enumerate(sizes):
        assert b"".join(x for _, x in sorted(by_doc[i])) == np.arange(n, dtype="<u4").tobytes()
    lost = 0
    for parts in by_sequence.values():
        ends = 0
        for at, n, _ in sorted(parts):
            assert at == ends and n > 0
            ends += n
        assert ends <= capacity
        lost += capacity - ends if ends & (ends - 1) else 0
    assert sorted(by_sequence) == list(range(5, 5 + len(by_sequence)))
    assert lost < packing.LEAST_GAP * len(by_sequence) * (0.5 if capacity > 100 else 1)
    cut = sum(len(by_doc[i]) > 1 for i, n in enumerate(sizes) if n <= capacity)
    assert cut <= len(by_sequence) and sum(map(len, by_doc.values())) <= len(sizes) + 2 * len(by_sequence)


def test_pack_with_a_tokenizer_that_keeps_blanks(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = ["one  two\n three", " lead", "İx ½"]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumns({"start": F.lit("x"), "ids": F.lit(1), "a.b": F.lit(2)})
    got = defaultdict(bytes)
    for r in sorted(packing.pack(frame, path=path).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] += bytes(r["ids"])
    whole = Tokenizer.from_file(path)
    assert got == {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in enumerate(texts)}


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_components(spark, docs, texts):
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_documents(docs).collect()}
    rows = sorted(texts)
    fps = [slow_fingerprint(t) for _, t in rows]
    for (i, _), fp, r in zip(rows, fps, brute_components(fps), strict=True):
        assert out[i] == (f"{fp:016x}", rows[r][0])


@pytest.mark.parametrize(("limit", "chunk"), [(40, 1 << 17), (4096, 1 << 17), (4096, 50)])
def test_index_and_refined_patterns(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(simhash, "GROUP", limit)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in np.repeat(base, 60)})
    want = brute_components(fps)
    for mask in (0, simhash.root_masks()[3]):
        a = simhash.codes(np.sort(simhash.placed(np.array(fps, np.uint64), mask)))
        own = [int(x) for x in simhash.scattered(a, mask)]
        assert sorted(own) == fps
        kept = ((1 << mask.bit_count()) - 1) << (64 - mask.bit_count())
        found = simhash.GrayIndex(a).search(a, exact=np.uint64(kept), after=np.arange(len(a)))
        got = [(int(x), int(y)) for q, f in found for x, y in zip(q, f, strict=True)]
        want_pairs = {(i, j) for j in range(len(own)) for i in range(j) if (own[i] ^ own[j]).bit_count() <= 4 and (own[i] ^ own[j]) & mask == 0}
        assert set(got) == want_pairs and len(got) == len(want_pairs)
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    star = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, chunk=chunk)).collect()}
    at = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(fps)}
    groups = defaultdict(set)
    for x, i in at.items():
        groups[star.get(x, x)].add(i)
    expected = defaultdict(set)
    for i, r in enumerate(want):
        expected[r].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_every_link_of_a_corpus_comes_from_the_index(spark):
    """On the whole fingerprints of sf0.01: the forests of all masks' indices give brute force's components."""
    texts = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    fps = np.array(sorted({simhash.fingerprint(t) for (t,) in texts}), np.uint64)
    at = {int(x): i for i, x in enumerate(fps)}
    pairs = []
    for mask in simhash.root_masks():
        places = np.sort(simhash.placed(fps, mask))
        root = simhash.linked(places, mask)
        own = [at[int(x)] for x in simhash.scattered(simhash.codes(places), mask)]
        pairs += [(own[i], own[int(r)]) for i, r in enumerate(root) if i != r]
    assert len(pairs) > 5
    star = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.BITS
    root = np.arange(len(fps))
    while True:
        new = np.array([root[row].min() for row in apart])
        if (new == root).all():
            break
        root = new
    assert [star.get(i, i) for i in range(len(fps))] == root.tolist()


def test_split_joins_equal_plain_ones(spark):
    from shapewright.llm import shared

    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(10**k if k < 4 else 3)] + [(9, 0)], "k long, i long")
    small = rows.where("k < 4").groupBy("k").count()
    for total in (1, 10**7, rows.count()):
        both = [sorted(map(tuple, x.collect())) for x in (shared.joined_by_size(rows, small, "k", "count", total, "left_anti"), rows.join(small, "k", "left_anti"))]
        assert both[0] == both[1]
        named = small.withColumn("n", small["count"] + 1)
        assert shared.joined_by_size(rows, named, "k", "count", total).select("k", "i", "n").exceptAll(rows.join(named, "k").select("k", "i", "n")).count() == 0
        assert shared.joined_by_size(rows, named, "k", "count", total).count() == 1111


def test_near_dedup_keeps_one(spark, edge):
    from pyspark.sql import functions as F

    more = edge.withColumns({"_fp": F.lit("x"), "id": F.lit("y"), "a.b": F.lit("z"), "root": F.lit(0)})
    for frame in (edge, more, edge.limit(0)):
        out = simhash.drop_near_duplicates(frame)
        assert out.columns == frame.columns
        rows = out.collect()
        if rows:
            ids = [r["doc_id"] for r in rows]
            assert ids.count(0) == 1 and 1 not in ids and ids.count(2) == 1 and ids.count(None) == 1 and 9 not in ids
        assert all(r["_fp"] == "x" and r["id"] == "y" and r["a.b"] == "z" for r in rows if "_fp" in frame.columns)


def test_near_dedup_without_keys(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(None, a, "en", "s", 0), (None, a, "en", "s", 0), (None, b, "en", "s", 0), (3, b, "en", "s", 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted([("None", a), ("3", b), ("None", "")])


def test_near_dedup_with_keys_of_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(3, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (6, b, "en", "s", 0), (7, c, "en", "s", 0), (7, d, "en", "s", 0), (7, d, "en", "s", 0)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, a), (5, b), (7, c), (7, d)]


def base_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
    find = lambda p: re.finditer(p, t)
    out = [(m.start(), 0, m.end()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [(m.start(), 1, m.end()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in sorted(out))


TRICKY = ["a@b.c@d.e f@g.h", "x..y@z-.q. @a.b c@", "1.2.3.4.5.6.7.8 999.1.1.1.1 001.002.003.004", "4111-1111 1111 1111 4111111111111111 41111111111111119", "+1 (555) 123-4567 x +49 30 1234567-- +1", "1.2.3.4@5.6.7.8", "4" * 500, "a" * 500 + "@", "+" * 50 + "1" * 20]


def test_pii(docs, texts):
    out = {r["doc_id"]: r["base_sha256"] for r in pii.pii_digests(docs).collect()}
    for i, t in texts:
        assert out[i] == hashlib.sha256(base_spans(t or "").encode()).hexdigest()


@pytest.mark.parametrize("text", TRICKY)
def test_pii_tricky(text):
    got = ",".join(f"{k}:{b}:{e}" for k, b, e, _ in pii.find(text) if k in pii.BASE)
    assert got == base_spans(text)


def test_pii_adds_and_redacts():
    text = "my IBAN is DE89370400440532013000 and mail a.b@c.org"
    spans = pii.find(text)
    assert [s[0] for s in spans] == ["iban", "email"] and pii.redact(text, spans) == "my IBAN is <IBAN> and mail <EMAIL>"
    assert not pii.mod97("DE89370400440532013001") and pii.find("DE89370400440532013001") == []


def test_added_kinds():
    found = lambda t: [(k, t[b:e]) for k, b, e, _ in pii.find(t) if k not in pii.BASE]
    good = "DE89370400440532013000"
    assert found(f"konto {good} UND MEHR") == [("iban", good)] and found("IBAN DE89 3704 0044 0532 0130 00 BANK") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found(f"x {good.lower()} y") == [] and found(f"iban {good.lower()} y") == [("iban", good.lower())]
    assert found(f"{good}X") == [] and found("GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found("ssn 123-45-6789") == [("ssn", "123-45-6789")] and found("no 123-45-6789") == [] and found("ssn 000-45-6789") == []
    key = "0123456789abcdef0123456789abcdef01234567"
    assert found(f"token = {key}") == [("secret", key)] and found(f"sha {key}") == [] and found("AB12 " * 20000) == []


def test_redacted_sizes(spark):
    from pyspark.sql import functions as F

    rows = [(1, "mail a.b@c.org now", "en", "s", 18), (2, None, "en", "s", None), (3, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"pii": F.lit(1), "redacted": F.lit("x"), "a.b": F.lit(2)})
    out = pii.redact_documents(frame)
    assert out.columns == frame.columns and sorted((r["doc_id"], r["text"], r["n_chars"], r["redacted"]) for r in out.collect()) == [(1, "mail <EMAIL> now", 16, "x"), (2, None, None, "x"), (3, "", 0, "x")]


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}x" for i in range(300)]
    words = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in words]
    rows, labels = [], []
    for i in range(1500):
        text, bad = list(rng.choice(words, 40)), i % 6 == 0
        text += [f"grumf{'abcdefgh'[rng.integers(8)]}", "zorkig"][: 1 + rng.integers(2)] if bad else []
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.scored_documents(docs, lab).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out) and len(out) == 1500
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) / len(held) > 0.97
    empty = toxicity.scored_documents(docs.limit(0), lab.limit(0))
    assert empty.count() == 0 and {r["predicted"] for r in toxicity.scored_documents(docs.limit(5), lab.limit(0)).collect()} == {0}


def test_label_model_recovers_rates_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    rates = np.array([(0.02, 0.7), (0.05, 0.6), (0.02, 0.5), (0.6, 0.1)])
    votes = np.stack([np.where(y, rng.random(6000) < b, rng.random(6000) < a) for a, b in rates], axis=1).astype(float)
    votes = np.concatenate((votes, votes[:, :1]), axis=1)  # a voter that copies the first
    p, found, edges, added = toxicity.posteriors(votes, np.array([1, 1, 1, 0, 1]), 0.3)
    odds = np.log(0.3 / 0.7) + votes[:, :4] @ np.log(rates[:, 1] / rates[:, 0]) + (1 - votes[:, :4]) @ np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
    best = ((odds > 0) == y).mean()  # with the true rates
    assert ((p > 0.5) == y).mean() > best - 0.04
    assert np.abs(found[1, :4] - rates[:, 1]).max() < 0.12 and np.abs(found[0, :4] - rates[:, 0]).max() < 0.05
    copy = [k for k, e in enumerate(edges.tolist()) if e == [0, 4]]
    assert len(copy) == 1 and added[copy[0]] == pytest.approx(-np.log(found[1, 0] / found[0, 0]), abs=0.1)


def test_label_model_equals_a_plain_one():
    """Expectation maximisation row by row, in plain Python."""
    from math import exp, log

    rng = np.random.default_rng(5)
    y = rng.random(300) < 0.4
    votes = (rng.random((300, 4)) < np.where(y[:, None], [0.7, 0.5, 0.4, 0.1], [0.1, 0.1, 0.05, 0.5])).astype(float)
    votes[:, 1] = np.maximum(votes[:, 1], votes[:, 0])
    label = [1, 1, 1, 0]
    got, _, edges, _ = toxicity.posteriors(votes, np.array(label), 0.4)
    assert len(edges)
    rows = [[*map(int, r), int(not any(r[:3]))] for r in votes]
    votes_for = [*label, 0]
    p = []
    for r in rows:
        up, down = any(v for v, c in zip(r, votes_for, strict=True) if c == 1), any(v for v, c in zip(r, votes_for, strict=True) if c == 0)
        p.append(0.9 if up else 0.1 if down else 0.4)
    pairs = []
    for step in range(toxicity.ROUNDS):
        n1, n0 = sum(p) + 1, sum(1 - x for x in p) + 1
        rate = lambda on: ((sum(x for x, r in zip(p, rows, strict=True) if on(r)) + 0.5) / n1, (sum(1 - x for x, r in zip(p, rows, strict=True) if on(r)) + 0.05) / n0)  # noqa: B023, E731
        each = [rate(lambda r, j=j: r[j]) for j in range(5)]
        if step % 10 == 5:
            pairs = [tuple(e) for e in toxicity.joined(np.array(rows, float), np.array(p), np.array([e[0] for e in each]), np.array([e[1] for e in each])).tolist()]
        twice = {(i, j): rate(lambda r, i=i, j=j: r[i] and r[j]) for i, j in pairs}
        most = {(i, j): min(abs(log(each[x][0] / each[x][1])) for x in (i, j)) for i, j in twice}
        extra = {(i, j): max(-most[i, j], min(most[i, j], log(a / (each[i][0] * each[j][0])) - log(b / (each[i][1] * each[j][1])))) for (i, j), (a, b) in twice.items()}
        p = [1 / (1 + exp(-(log(0.4 / 0.6) + sum(log(each[j][0] / each[j][1]) for j in range(5) if r[j]) + sum(v for (i, j), v in extra.items() if r[i] and r[j])))) for r in rows]
    assert got.tolist() == pytest.approx(p, abs=1e-6)


def test_classifier_minimises_its_loss():
    """No small step in any direction makes the penalised loss smaller by more than a trifle."""
    rng = np.random.default_rng(8)
    lists = [sorted(set(rng.integers(0, 12, 4).tolist()) | ({12} if i % 3 == 0 else set())) for i in range(400)]
    targets = np.array([0.95 if 12 in x else 0.05 for x in lists])
    rows = toxicity.Rows.of(lists, 13)
    w, bias = toxicity.train(rows, targets)
    share = targets.mean()
    sample = np.where(targets >= 0.5, 0.5 / share, 0.5 / (1 - share)) / len(targets)
    norm = np.sqrt(np.maximum(rows.back(np.ones(400)), 1) / 400)

    def loss(w, bias):
        z = np.array([sum(w[i] for i in x) + bias for x in lists])
        return float((sample * (np.logaddexp(0, z) - targets * z)).sum() + toxicity.L1 * ((1 + 20 * norm) * np.abs(w)).sum())

    here = loss(w, bias)
    assert all(loss(w + d * np.eye(13)[i], bias) > here - 1e-4 for i in range(13) for d in (-0.2, -0.02, 0.02, 0.2)) and loss(w, bias + 0.05) > here - 1e-4
    assert w[12] > 1


def test_toxicity_edges(spark):
    from pyspark.sql import functions as F

    calm, bad = "good day to all of you my friends", "you idiot shut up you moron"
    rows = [(i, bad + f" x{i}" if i % 4 == 0 else calm + f" y{i}", "en", "s", 0) for i in range(400)]
    rows += [(401, bad, "en", "s", 0)] * 2000 + [(402, None, "en", "s", 0), (403, "", None, None, 0), (None, bad, "en", "s", 0), (404, LONG, "en", "s", 0)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(401, 1, 1), (401, 1, 1), (None, 0, 1), (405, 1, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "a.b": F.lit(1), "h": F.lit(2)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.sampled(docs, lab).select("key", "h").distinct().count() <= 402
    assert toxicity.fit(docs, lab).weights == toxicity.fit(docs.dropDuplicates(["doc_id"]), lab).weights
    out = toxicity.scored_documents(docs, lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["held_out"], r["predicted"]))
    assert {x for _, x in by[401]} == {x for _, x in by[None]} == {1} and {x for i in (402, 403, 404) for _, x in by[i]} == {0}
    whole = toxicity.score_toxicity(docs, toxicity.fit(docs, lab))
    assert dict(whole.dtypes)["score"] == "double" and whole.columns[-2:] == ["score", "predicted"] and "a.b" in whole.columns


def slow_pipeline(rows, model):
    """doc_id: (copies, tokens of a copy) after language, near-duplicates, personal data and mixture, of rows with different ids."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    alike = model.predict([r[1] for r in rows])[2]
    kept = sorted(r for r, x in zip(rows, alike, strict=True) if r[1] and any(c.isalpha() for c in r[1]) and x >= langid.LEAST_LIKENESS)
    roots = brute_components([slow_fingerprint(r[1]) for r in kept])
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    clean = {r[0]: pii.redact(r[1], pii.find(r[1])) for r in kept}
    copies = slow_mix(kept, dict.fromkeys({r[3] for r in kept}, 1.0))
    return {i: (n, len(whole.encode(clean[i], add_special_tokens=False).ids) + 1) for i, n in copies.items() if n}


def test_pipeline_equals_a_plain_one(spark, tmp_path, docs):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    edge = [(10_000 + i, *r[1:]) for i, r in enumerate(EDGE) if r[1] != "😀 \x0b\x1c tab\tİstanbul ΣΑΣ <|endoftext|> it's 12 34"]
    frame = docs.unionByName(spark.createDataFrame(edge, DOCS)).withColumns({"score": F.lit(1), "copy_no": F.lit("x"), "_fp": F.lit(2), "a.b": F.lit(3)})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    got = defaultdict(lambda: [0, set()])
    for r in out:
        got[r["doc_id"]][0] += r["length"]
        got[r["doc_id"]][1].add(r["doc_tokens"])
    want = slow_pipeline([tuple(r)[:5] for r in frame.collect()], langid.fit(frame))
    assert {k: (n, t) for k, (n, t) in got.items()} == {k: (n * t, {t}) for k, (n, t) in want.items()}


def test_pipeline_of_nothing(spark, tmp_path, edge):
    import corpus_pipeline as P

    edge.limit(0).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    edge.where("text IS NULL OR text = ''").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "a")).count() == 0 and P.run(spark, str(tmp_path / "b")).count() == 0


def test_pipeline_stages(spark, edge):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge)
    for _, stage in P.STAGES[:-1]:
        new = stage(spark, now, SF).cache()
        assert new.columns == edge.columns and new.count()
        now = new
    assert P.STAGES[-1][1](spark, now, SF).agg({"length": "sum"}).first()[0] > 0
    assert P.run(spark, SF).count() > 0


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("same", [False, True])
def test_a_repeated_key_takes_no_language_away(spark, docs, last, same):
    """A key of 10,000 rows, first or last by the hash that samples go by, leaves the model as one row of it does."""
    from pyspark.sql import functions as F

    known = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")) * (-1 if last else 1)).first()["doc_id"]
    one = docs.where(F.col("doc_id") == key).limit(1)
    text = F.col("text") if same else F.concat(F.col("text"), F.lit(" "), F.col("i").cast("string"))
    many = one.crossJoin(spark.range(10_000).withColumnRenamed("id", "i")).withColumn("text", text).drop("i")
    crowded = docs.where(F.col("doc_id") != key).unionByName(many)
    model, plain = langid.fit(crowded), langid.fit(docs)
    assert model.languages == plain.languages and len(model.languages) == 4
    if same:
        assert np.allclose(model.weights, plain.weights)
    texts = [r[0] for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).select("text").collect()]
    assert model.predict(texts)[0] == plain.predict(texts)[0]


@pytest.mark.parametrize("last", [False, True])
def test_a_labelled_key_of_many_texts_counts_once(spark, last, monkeypatch):
    from pyspark.sql import functions as F

    calm, bad = "good day to all of you my friends", "you idiot shut up you moron"
    rows = [(i, bad + f" x{i}" if i % 4 == 0 else calm + f" y{i}", "en", "s", 0) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "PER_LABEL", 200)
    clean = toxicity.learnable(lab).where("toxic = 0")
    key = clean.orderBy(F.xxhash64(F.lit("sample"), "key") * (-1 if last else 1)).first()["key"]
    many = spark.range(7000).select(F.lit(int(key)).alias("doc_id"), F.concat(F.lit("you idiot "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    found = toxicity.sampled(docs.unionByName(many), lab)
    assert found.where(F.col("key") == key).count() <= 1 and found.where("toxic = 0").count() >= 199
    out = toxicity.scored_documents(docs.unionByName(many).where(F.col("doc_id") != int(key)), lab).collect()
    assert [r["doc_id"] for r in out if r["predicted"] != int(r["doc_id"] % 4 == 0)] == []


def test_null_keys_are_not_held_out(spark, edge):
    for out in (langid.identified_documents(edge), toxicity.scored_documents(edge, spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"))):
        assert {r["held_out"] for r in out.where("doc_id IS NULL").collect()} == {False}
