"""Hosts in texts by an index, hosts of other scripts in ASCII, Hangul in its parts: against literal rules and the standards."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from sourceloom.functions.hosts import ascii_host
from sourceloom.functions.text import split_hangul, title_tokens
from sourceloom.functions.url import canonical_url, domain_matches_name
from sourceloom.operators import analysis


def test_hosts_seen_against_the_rule(spark):
    rng = random.Random(5)
    hosts = ["acme.com", "example.org", "www.example.org", "ample.org", "a.b.c.d", "b.c", "co.uk", "localhost", "with_line.com", "ex-ample.org", "münchen.de"]
    bits = ["acme.com", "ACME.com", "xacme.com", "acme.com.br", "www.example.org", "example.org/path", "https://example.org?q=1", "-example.org", "a.b.c.d.e", "..b.c..", "localhost", "my-localhost", "with_line.com", "xwith_line.com", "münchen.de", "(co.uk)", "text", ",", "acme", ".com"]
    seen = [(f"r{rng.randrange(6)}", rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(0, 5)))) for _ in range(60)] + [("r1", None), (None, "acme.com")]
    asked = [(f"r{i}", h) for i in range(7) for h in hosts]
    got = analysis.hosts_seen(spark.createDataFrame(asked, "research_id string, host string"), spark.createDataFrame(seen, "research_id string, text string"))
    rule = lambda text, h: re.search(rf"(?:^|[^a-z0-9-]){re.escape(h)}(?:$|[^a-z0-9-])", (text or "").lower())
    want = sorted({(r, h) for r, h in asked for q, text in seen if q == r and rule(text, h)})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 15 and {h for _, h in want} > {"with_line.com", "localhost", "münchen.de"}
    none = analysis.hosts_seen(spark.createDataFrame([], "research_id string, host string"), spark.createDataFrame(seen, "research_id string, text string"))
    assert none.count() == 0


def test_hosts_in_ascii(spark):
    rng = random.Random(6)
    hosts = ["münchen.de", "bücher.example", "例え.jp", "пример.испытание", "☃.net", "faß.de", "日本語.co.jp", "a.b", "ü", "😀.ws", "xn--mnchen-3ya.de", "他们为什么不说中文", "ليهمابتكلموشعربي؟", "-> $1.00 <-é", "3年b組金八先生", "例え。テスト", "a" * 40 + "é" * 20]
    hosts += ["".join(rng.choice("abcz09-éßñ日本語한국Ж😀") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    want = [".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in re.split("[.。．｡]", h)) for h in hosts]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").repartition(1).orderBy("i").select(ascii_host(F.col("h"))).collect()]
    assert got == want
    urls = spark.createDataFrame([("http://www.MÜNCHEN.de/x",), ("https://xn--mnchen-3ya.de/x/",), ("https://例え.jp:443",)], "u string")
    assert [r[0] for r in urls.select(canonical_url(F.col("u"))).collect()] == ["https://xn--mnchen-3ya.de/x", "https://xn--mnchen-3ya.de/x", "https://xn--r8jz45g.jp/"]


def test_hangul_in_parts(spark):
    texts = ["한국 스타트업, 서울", "가힣", "각 x 힣a", "plain", "", None, "".join(chr(c) for c in range(0xAC00, 0xD7A4, 97))]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(split_hangul(F.col("t"))).collect()]
    assert got == [t and unicodedata.normalize("NFD", t) for t in texts]
    both = spark.createDataFrame([("한국 뉴스 €16 million",), (unicodedata.normalize("NFD", "한국 뉴스 €16 million"),)], "t string").select(title_tokens(F.col("t"))).collect()
    assert both[0] == both[1] and len(both[0][0]) == 3


def test_labels_with_affixes(spark):
    rows = [("acme.com", "Acme Inc", True), ("getacme.io", "Acme", True), ("acmepay.com", "Acme", True), ("getacmepay.com", "Acme", False), ("acmex.com", "Acme", False), ("ac.com", "Ac", False), ("x.acme.co.uk", "ACME", True), ("acme", "Acme", False), (None, "Acme", False), ("1.2.3.4", "1234", False)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string, n string, w boolean").select(domain_matches_name(F.col("d"), F.col("n"))).collect()]
    assert got == [w for _, _, w in rows]
