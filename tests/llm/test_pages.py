"""Archives and host reputation."""

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import archives, reputation

PAGES = "page_id long, url string, html string, key string, ord long, host string, bad string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "h", "b") for r in rows], PAGES)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, tmp_path, version):
    p = archives.Archives(archive_bytes=400, version=version)
    texts = {i: None if i == 3 else "é\r\n\r\nWARC/1.0\n" * (i % 5) for i in range(40)}
    df = pages(spark, [(i, None if i == 5 else f"http://x.org/ä b{i}", t) for i, t in texts.items()])
    archives.write_arc(df.select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload")), f"{tmp_path}/arc", p)
    archives.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", p)
    rows = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted(r.page_id for r in rows) == sorted(texts)
    last = {t or "": max(i for i, u in texts.items() if (u or "") == (t or "")) for t in texts.values()}
    for r in rows:
        t = texts[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(t.encode()), archives.sha1_base32(t.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if last[t] == r.page_id else ("revisit", last[t]))
        assert r.warc_date == "2024-01-01T00:00:00Z" and r.url == ("-" if r.page_id == 5 else f"http://x.org/%C3%A4%20b{r.page_id}")
    assert len({r.record_id for r in rows}) == 40


def test_least_bytes_and_odd_rows(spark, tmp_path):
    rows = [(1, "u", "long text"), (2, "u", "long text"), (2, "u", "long text"), (3, None, None), (4, "", ""), (None, "u", "long text"), (None, None, None), (9, "u", "x" * 300_000)]
    df = pages(spark, rows).select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload"))
    p = archives.Archives(archive_bytes=100, least_bytes=5)
    archives.write_arc(df, f"{tmp_path}/arc", p)
    archives.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", p)
    out = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(out) == 8
    long = [r for r in out if r.payload_bytes == 9]
    assert [r.record_type for r in long].count("response") == 1 and {r.refers_to for r in long if r.record_type == "revisit"} == {2}
    assert all(r.record_type == "response" for r in out if r.payload_bytes == 0)
    archives.write_arc(df.limit(0), f"{tmp_path}/none", p)
    archives.convert_arc(spark, f"{tmp_path}/none", f"{tmp_path}/nothing", p)
    assert archives.read_warc(spark, f"{tmp_path}/nothing").count() == 0


def test_hand_written_archive():
    body = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    data = b"filedesc://a.arc 0.0.0.0 19990102 text/plain 200 - - 0 a.arc %d\n%s\n" % (len(body), body)
    data += b"http://a/ 1.2.3.4 19990102030405 text/plain 200 abc - 99 a.arc 5\nhello\n\nhttp://b/ 1.2.3.4 1999 image/gif 200 - - 9 a.arc 22\nHTTP/1.0 200 OK\r\n\r\nGIF\n"
    first, second = archives.read_arc(data)
    assert (first.url, first.date, first.head, first.payload) == ("http://a/", "19990102030405", b"", b"hello")
    assert (second.head, second.payload) == (b"HTTP/1.0 200 OK\r\n\r\n", b"GIF")
    kinds = [r.fields["warc-type"] for r in archives.parse_warc(b"".join(archives.to_warc("x/a.arc.gz", data, {})))]
    assert kinds == ["warcinfo", "resource", "response"]
    assert archives.warc_date("19990102030405") == "1999-01-02T03:04:05Z" and archives.warc_date("1999") == "1999-01-01T00:00:00Z" and archives.warc_date("?") == "1970-01-01T00:00:00Z"
    cut = list(archives.read_arc(data[:-9]))
    assert [r.damage for r in cut] == [None, "cut"] and cut[1].head + cut[1].payload == b"HTTP/1.0 200 O"
    twin = list(archives.parse_warc(b"".join(archives.to_warc("x/a.arc", data[:-9], {}))))
    assert twin[2].fields["warc-truncated"] == "unspecified" and twin[2].block.endswith(b"200 O")
    with pytest.raises(ValueError):
        list(archives.parse_warc(b"".join(archives.to_warc("x/a.arc", data, {}))[:-7]))
    assert hashlib.sha1(b"hello").digest() and archives.record_id("p/a.gz", 1) == archives.record_id("q/a.gz", 1)


def test_bytes_blanks_and_damage(spark, tmp_path):
    """Payloads that are no UTF-8, urls with blanks, lines that are no header, gzip of one
    member, of many and none: every byte comes back."""
    gif, latin = b"GIF89a\x00\xff\xfe\r\n\r\n\x80" * 9, "caf\u00e9 na\u00efve\r\n".encode("latin-1") * 5
    first = b"filedesc://a.arc 0.0.0.0 19990102 text/plain 12\n1 0 someone\n\n"
    row = lambda url, kind, body: b"%s 1.2.3.4 19990102030405 %s %d\n%s\n" % (url, kind, len(body), body)
    parts = [first, row(b"http://a/x y z.gif", b"image/gif", gif), b"!! torn \xff line\nmore\n", row(b"http://b/\xe9", b"text/html; charset=x", latin), row(b"http://c/", b"text/html", gif), row(b"http://d/", b"application/x", random.Random(5).randbytes(900))]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "plain.arc").write_bytes(b"".join(parts))
    (folder / "one.arc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (folder / "many.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (folder / "torn.arc.gz").write_bytes(gzip.compress(b"".join(parts))[:-200])
    rows = archives.arc_records(spark, str(folder)).collect()
    by = {name: sorted((r.ord, r.bytes, r.digest, r.damage) for r in rows if name in r.path) for name in ("plain", "one", "many", "torn")}
    want = [(0, gif, None), (1, b"!! torn \xff line\nmore\n", "header"), (2, latin, None), (3, gif, None), (4, random.Random(5).randbytes(900), None)]
    assert by["plain"] == by["one"] == by["many"] == [(k, len(x), archives.sha1_base32(x), d) for k, x, d in want]
    assert by["torn"][:4] == by["plain"][:4] and by["torn"][4][3] == "cut" and 600 < by["torn"][4][1] < 900
    archives.convert_arc(spark, str(folder), f"{tmp_path}/warc")
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    records = [r for f in files for r in archives.parse_warc(f)]
    assert len(files) == 4 and all(len(members(f)) == len(list(archives.parse_warc(f))) + 1 for f in files)
    whole = [r for r in records if r.fields["warc-type"] == "resource" and "x-damage" not in r.fields]
    assert {r.block for r in whole} == {gif, latin, want[4][1]} and sum(r.fields["warc-type"] == "revisit" for r in records) >= 7
    assert {"http://a/x%20y%20z.gif", "http://b/%E9"} <= {r.fields["warc-target-uri"] for r in records if "warc-target-uri" in r.fields}


def members(data):
    """The gzip members of a file, each inflated; nothing may be between or after them."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        assert z.eof
        data = z.unused_data
    return out


def test_urls(spark):
    urls = ["http://A.b.CO.UK:80/x/y?q#f", "https://org", "//a/b", None, "", "ftp://Example.org/es/1", "http://example.org?x=/y", "http://sub.example.org/en/12", "http://org/", "x://y://z/w", "http://a.com/fr/", "http://com/de/x", "http://notcom/fr/", "http://example.org/en/2", "http://a\nb.com/fr/\n"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    h, p = reputation.host_of(F.col("url")), reputation.path_of(F.col("url"))
    rule, verdict = reputation.rule_of(h, p)
    got = {r.id: (r.h, r.p, r.r, r.v) for r in df.select("id", h.alias("h"), p.alias("p"), rule.alias("r"), verdict.alias("v")).collect()}
    assert got[0] == ("a.b.co.uk:80", "/x/y", None, None) and got[1] == ("org", "", None, None)
    assert all(got[i] == ("", "", None, None) for i in (2, 3, 4))
    assert got[5][2:] == ("example.org/es/", "block") and got[6] == ("example.org", "", None, None) and got[7][2:] == ("example.org/en/1", "block")
    assert got[8][2:] == ("org/", "allow") and got[9][:2] == ("y:", "//z/w") and got[10][2:] == ("com/fr/", "allow") and got[11][2:] == ("com/de/", "block")
    assert got[12][2:] == (None, None) and got[13][2:] == ("org/", "allow") and got[14] == ("a\nb.com", "/fr/\n", "com/fr/", "allow")
    d = reputation.domain_of(F.col("h"), reputation.suffix_of(F.col("h"), reputation.Reputation()))
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.example.com",), ("com",), ("",)], "h string")
    assert [r[0] for r in hosts.select(d).collect()] == ["b.co.uk", "co.uk", "example.com", "com", ""]


def test_reputation(spark):
    rows = [(i, f"http://h{i % 20}.d{i % 4}.net/p{i}", "t") for i in range(2000)] + [(5000, "http://new.d1.net/", "t"), (5001, None, None), (None, "http://other.zz/", "t"), (5001, None, None)]
    labelled = spark.createDataFrame([(u, int(i % 20 == 7 or (i % 20 == 3 and i < 20))) for i, u, _ in rows[:2000]] + [(None, 1), ("http://h1.d1.net/", None)], "url string, bad int")
    out = reputation.judge_urls(pages(spark, rows), labelled)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all((got[i].verdict == "block") == (i % 20 == 7) for i in range(2000))
    assert 0 < got[3].bad_mean < 0.2 and got[5000].verdict == "allow" and got[5000].bad_mean < 0.5
    big = reputation.judge_urls(pages(spark, rows), labelled, p=reputation.Reputation(small_hosts=0))
    assert big.exceptAll(out).count() == 0
    none = reputation.judge_urls(pages(spark, rows), labelled.limit(0))
    assert {r.verdict for r in none.where("rule IS NULL").collect()} == {"allow"}
    assert reputation.judge_urls(pages(spark, rows).limit(0), labelled).count() == 0


def test_beta_tails(spark):
    """Against sums over a fine grid of the density."""
    import numpy as np

    cases = [(0.9, 3.0), (0.2, 2.0), (0.5, 40.0), (0.97, 11.5), (0.51, 20_000.0), (0.03, 900.0), (0.6, 0.9)]
    df = spark.createDataFrame(cases, "mean double, size double")
    got = [r[0] for r in df.select(reputation.chance_over(F.col("mean"), F.col("size"), 0.5)).collect()]
    u = (np.arange(4_000_000) + 0.5) / 4_000_000
    for (mean, size), chance in zip(cases, got, strict=True):
        # x = u^3 / (u^3 + (1-u)^3) softens both ends
        odds = 3 * (np.log(u) - np.log1p(-u))
        x = 1 / (1 + np.exp(-odds))
        log = mean * size * np.log(x) + (1 - mean) * size * np.log1p(-x) - np.log(u) - np.log1p(-u)
        w = np.exp(log - log.max())
        assert chance == pytest.approx(w[x > 0.5].sum() / w.sum(), abs=2e-6), (mean, size)


def test_suffix_list(spark, tmp_path):
    (tmp_path / "list").write_text("// comment\ncom\nblogspot.com\n*.ck\n!www.ck\nCity.Kobe.jp\n")
    found = reputation.read_suffixes(spark, str(tmp_path / "list"))
    assert found == ("blogspot.com", "city.kobe.jp")
    p = reputation.Reputation(suffixes=found)
    hosts = spark.createDataFrame([("a.b.blogspot.com",), ("x.city.kobe.jp",), ("a.org.uk",), ("blogspot.com",), ("q.r.com",), ("",)], "h string")
    s = reputation.suffix_of(F.col("h"), p)
    assert [r[0] for r in hosts.select(reputation.domain_of(F.col("h"), s)).collect()] == ["b.blogspot.com", "x.city.kobe.jp", "a.org.uk", "blogspot.com", "r.com", ""]
