import base64
import gzip
import hashlib
import random

from fixtures import collect, tables

from tallyforge.llm import warc_index as W
from tallyforge.llm.common import open_fs, scratch, written


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    last = {}
    for i, _, h in rows:
        d = digest(h)
        last[d] = max(last.get(d, -1), -1 if i is None else i)
    out, done = [], set()
    for i, _, h in rows:
        d = digest(h)
        first = (-1 if i is None else i) == last[d] and d not in done
        if first:
            done.add(d)
        out.append((str(i), len((h or "").encode()), d, "response" if first else "revisit", "None" if first else str(last[d])))
    return sorted(out)


def pages(seed=1, n=200):
    rng = random.Random(seed)
    htmls = ["", None, "<p>é</p>", "same", "x" * 70_000] + [f"<p>{k}</p>" for k in range(60)]
    urls = ["http://A.example.com/x y", "https://a.example.com:8080/b?c=1#top", None, "", "no scheme/at all", "http://é.de/\nq"]
    return [(i, rng.choice(urls + [f"http://h{rng.randrange(9)}.org/{i}"]), rng.choice(htmls)) for i in rng.sample(range(1000), n)]


def result(spark, rows):
    got = W.op10_warc(spark, tables(pages=rows)).collect()
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)


def test_equals_brute_force(spark):
    rows = pages()
    assert result(spark, rows) == brute(rows)


def test_hot_payloads_repeats_nulls_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT_SHARE", 3)
    rows = [(i, f"http://x.org/{i}", "one page that most share") for i in range(50)] + pages(2, 40)
    rows = list({r[0]: r for r in rows}.values())
    rows += [rows[-1], (None, "http://n.org/", "only here"), (5000, "http://p.org/", "twice"), (5000, "http://p.org/", "twice")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_index_finds_urls_and_archives_are_gzip(spark, monkeypatch):
    monkeypatch.setattr(W, "LINES", 7)
    rows = pages(3, 300)
    folder = scratch(spark, "test-warc")
    path = tables(pages=rows)
    lines = written(W.write_archives(W.decide(spark.read.parquet(path + "/pages.parquet")), folder), "test-lines")
    W.write_index(lines, folder, 4)
    index = W.Index(folder)
    assert [x[0] for x in index.files] == sorted(x[0] for x in index.files)
    for url in {r[1] for r in rows} | {"http://nowhere.net/"}:
        want = sorted(i for i, u, _ in rows if W.surt(u) == W.surt(url))
        found = index.find(url)
        assert sorted(x[1] for x in found) == want
        for _, page, archive, offset, length in found:
            r = index.read(archive, offset, length)
            assert int(r["x-page-id"]) == page
    fs, root = open_fs(folder)
    name = found[0][2] if found else lines.first()["archive"]
    assert gzip.decompress(fs.open_input_stream(f"{root}/archive/{name}", compression=None).read()).startswith(b"WARC/1.1\r\n")


def test_surt():
    assert W.surt("http://www.A.com:80/b?c#d") == "com,a,www:80)/b?c"
    assert W.surt(None) == W.surt("") == ")"


def test_urls_with_separators(spark):
    """Every character that line and word splitting treat specially."""
    odd = [chr(c) for c in range(0x21)] + ["\x7f", "\x85", "\xa0", "\u2028", "\u2029"]
    rows = [(i, f"http://h{i % 3}.org/a{c}b", f"<p>{i % 7}</p>") for i, c in enumerate(odd)]
    assert result(spark, rows) == brute(rows)
    assert all(len(W.surt(u).split()) == 1 and len(W.surt(u).splitlines()) == 1 for _, u, _ in rows)
    assert len({W.surt(u) for _, u, _ in rows}) == len(rows)
