"""Golden values of the column functions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from footfall.functions import addresses, agents, hashes, text, urls
from footfall.sources.hits import decode_base64url, encode_base64url


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


# Positions and their parts.
RECOVER = [
    ("320480", 1920, "320,480"),
    ("320480", 400, "320,480"),
    ("100200", 1920, "100,200"),
    ("00", 1920, "0,0"),
    ("01", 1920, "0,1"),
    ("50100", 320, "50,100"),
    ("12345678", 1920, "1234,5678"),
    ("1234", 1920, None),
    ("42135", 1024, None),
    ("999991", 99999, None),
    ("320480", 2560, None),
    ("319200", 1920, None),
    ("5", 1920, None),
    ("", 1920, None),
    ("abc", 1920, None),
    ("320480", 0, None),
    ("320480", -1, None),
]


def test_position_recover(spark):
    got = values(spark, [r[:2] for r in RECOVER], "p string, w int", text.recover_position("p", "w"))
    assert got == [r[2] for r in RECOVER]


def test_position_check(spark):
    kept = ["320,480", "0,0", "3840,2160", "99999,99999", "007,042"]
    empty = ["100000,200", "320480", "1,2,3", ",200", "200,", "-5,300", " 320 , 480 ", "320,,480", ",", "abc"]
    got = values(spark, [(p,) for p in [*kept, " 320,480 ", *empty]], "p string", text.click_position("p"))
    assert got == [*kept, "320,480"] + [""] * len(empty)


# Agents whose answers are known.
BOTS = [
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; Googlebot/2.1; +http://www.google.com/bot.html) Chrome/130.0.6723.117 Safari/537.36",
    "Googlebot-Image/1.0",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "Googlebot/2.1 (+http://www.google.com/bot.html)",
    "Mediapartners-Google",
    "Mozilla/5.0 (compatible; Google-InspectionTool/1.0)",
    "Mozilla/5.0 (compatible; Google-Site-Verification/1.0)",
    "GoogleOther",
    "DuplexWeb-Google",
    "YandexDirect/3.0",
    "WhatsApp/2.19.81 A",
    "anthropic-ai/1.0",
    "cohere-ai",
    "",
    None,
    "Mozilla/5.0 (Linux; Android 6.0.1; Nexus 5X Build/MMB29P) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.6723.117 Mobile Safari/537.36 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm) Chrome/116.0.1938.76 Safari/537.36",
    "Mozilla/5.0 (Linux; Android 6.0.1; Nexus 5X Build/MMB29P) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.6723.117 Mobile Safari/537.36 (compatible; Google-InspectionTool/1.0)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/49.0.2623.75 Safari/537.36 Google Favicon",
    "GoogleOther-Image/1.0",
    "GoogleAgent-Mariner",
    "Google-Safety",
    "Mozilla/5.0 (Linux; Android 11; Pixel 2) AppleWebKit/537.36 DuplexWeb-Google/1.0",
    "Mozilla/5.0 (Windows NT 6.1; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/41.0.2272.118 Safari/537.36 BingPreview/1.0b",
    "YandexFavicons/1.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 SkypeUriPreview Preview/0.5",
    "Mozilla/5.0 (compatible; SomeSpider/2.0; owner@example.com)",
]
# Agents whose answers are known.
PEOPLE = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Safari/537.36 Edg/130.0.0.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
]


def test_agents(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(BOTS + PEOPLE)], "n int, user_agent string")
    rows = {r.n: r for r in agents.enrich_agents(df).collect()}
    assert len(rows) == len(BOTS) + len(PEOPLE)
    assert all(rows[i].browser_type == 1 for i in range(len(BOTS)))
    assert all(rows[i].browser_type != 1 for i in range(len(BOTS), len(rows)))
    assert rows[3].browser == "BingBot"


@pytest.mark.parametrize("secret", ["short", "x" * 80])
def test_hmac(spark, secret):
    got = values(spark, [("héllo",)], "m string", hashes.hmac_sha256("m", secret))
    assert got == [hmac.new(secret.encode(), "héllo".encode(), hashlib.sha256).hexdigest()]


# One agent per family with browser, version, kind and platform.
FAMILIES = [
    ("BlackBerry9700/5.0.0.593 Profile/MIDP-2.1 Configuration/CLDC-1.1", "BlackBerry", "0", 2, "unknown"),
    ("SAMSUNG-SGH-E250/1.0 Opera Mini/7.1", "Opera Mini", "7.1", 2, "unknown"),
    ("Mozilla/4.0 (compatible; MSIE 6.0; Windows NT 5.1; SV1)", "IE", "6", 0, "winxp"),
    ("Mozilla/4.0 (compatible; MSIE 7.0; AOL 9.0; Windows NT 5.1)", "AOL", "9", 0, "winxp"),
    ("Mozilla/5.0 (X11; U; Linux i686; en-US; rv:1.9) Gecko/2008 Iceweasel/3.0", "Iceweasel", "3", 0, "linux"),
    ("Mozilla/5.0 (X11; U; Linux i686; en-US; rv:1.7) Gecko/20041107", "Mozilla", "1.7", 0, "linux"),
    ("Mozilla/5.0 (Windows NT 6.3; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36 Edge/12.0", "IE", "11", 0, "win8.1"),
    ("Dillo/2.0", "Dillo", "2", 0, "unknown"),
    ("FeedBurner/1.0 (http://www.FeedBurner.com)", "FeedBurner", "1", 1, "unknown"),
    ("Opera/9.80 (Windows NT 6.1; U; en) Presto/2.10 Version/12.16", "Opera", "9.8", 0, "win7"),
    ("Mozilla/5.0 (Windows NT 10.0; Touch; rv:11.0; Trident/7.0) like Gecko", "IE", "11", 2, "wi10"),
    ("Mozilla/4.0 (compatible; MSIE 6.0; Windows CE; IEMobile 7.11)", "IEMobile", "7.11", 2, "winphone8"),
    ("Mozilla/5.0 (X11; U; FreeBSD 8.0 i386; en-US) Gecko/20091105 Firefox/3.5", "Firefox", "3.5", 0, "freebsd 8.0"),
    ("Lynx/2.8.5rel.1 libssl/0.9", "Lynx", "2.8", 0, "unknown"),
    ("Nokia6630/1.0 (2.3.129) SymbianOS/8.0", "Nokia", "0", 2, "symbianos"),
    ("Mozilla/5.0 (Linux; U; Android 4.0.3) AppleWebKit/534.30 (KHTML, like Gecko) Version/4.0 Mobile Safari/534.30", "Default Browser", "4", 2, "android"),
    ("Mozilla/5.0 (Windows NT 6.1) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36", "Chrome", "36", 0, "win7"),
    ("Mozilla/5.0 (compatible; SomeSpider/2.5; +http://example.com)", "SomeSpider", "2.5", 1, "unknown"),
    ("Wget/1.21", "Wget", "1.21", 1, "unknown"),
    ("<script>drop table hits</script> in the name of an agent", "Script Injection Bot", "0", 1, "unknown"),
]


def test_agent_families(spark):
    rows = agents.enrich_agents(spark.createDataFrame([(f[0],) for f in FAMILIES], "user_agent string")).collect()
    got = {r.user_agent: (r.browser, r.browser_version, r.browser_type, r.platform) for r in rows}
    assert got == {f[0]: f[1:] for f in FAMILIES}


def test_address_hash_length(spark):
    got = values(spark, [("1.2.3.4", "agent")], "ip string, ua string", hashes.hash_address("ip", "ua", "k", F.lit("salt")))
    assert got == [hmac.new(b"k", b"salt|1.2.3.4|agent", hashlib.sha256).hexdigest()[:39]]


def test_masks_and_ranges(spark):
    rows = [("192.168.3.77",), ("2001:db8:1:2:3:4:5:6",), ("nonsense",)]
    assert values(spark, rows, "a string", addresses.mask_address("a")) == ["192.168.3.0", "2001:db8:1::", "nonsense"]
    inside = addresses.in_ranges("a", ["192.168.0.0/22", "2001:db8::/32"])
    assert values(spark, rows, "a string", inside) == [True, True, False]


def test_resource_and_hosts(spark):
    got = values(spark, [("https://a.org/caf%C3%A9?x=1#t",), ("/plain/%zz",), ("/a b",)], "u string", urls.normalise_resource("u"))
    assert got == ["/caf%c3%a9?x=1#t", "/plain/%zz", "/a b"]
    hosts = [("www.google.de",), ("m.yahoo.co.jp",), ("search.aol.com",), ("fr.wow.com",), ("bing.com",)]
    assert values(spark, hosts, "h string", urls.lossy_host("h")) == ["google.{}", "yahoo.{}", "aol.com", "{}.wow.com", "bing.com"]


def test_domain_keeps_five_labels(spark):
    got = values(spark, [("https://www.a.b.c.d.e/x",), ("plain.org/y",)], "r string", urls.referrer_domain("r"))
    assert got == ["a.b.c.d.e", "plain.org"]


def test_wildcards(spark):
    got = values(spark, [("/blog/a",), ("/BLOG/",), ("/x1",), ("/x12",), (None,)], "r string", text.matches_wildcard("r", "/blog/*, /x!"))
    assert got == [True, True, True, False, None]


def test_base64url_round_trip(spark):
    words = [("https://example.com/?a=ü&b=1",), ("x" * 200,), ("??>>",)]
    assert values(spark, words, "t string", decode_base64url(encode_base64url("t"))) == [w[0] for w in words]
    assert values(spark, [("!",)], "t string", decode_base64url("t")) == [None]


def test_link_limit(spark):
    rows = [(None, "u"), ("", "u"), ("a", "u"), ("a" * 2044, "u"), ("a" * 2045, "u")]
    got = values(spark, rows, "l string, u string", text.append_link("l", "u"))
    assert got == ["u", "u", "a;;;u", "a" * 2044 + ";;;u", "a" * 2045]
