"""Browser, version, kind and platform out of a user agent text.

An agent is cut into tokens. Each token, its leading letters, and each token with the one behind it are looked up in a
table of words by one equality join; the answer of the lowest rank wins (`min_by`). What no word names is told by the
products outside brackets. All of it runs once per distinct agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import as_column

DESKTOP, BOT, MOBILE, READER = 0, 1, 2, 3
UNKNOWN_BROWSER = "Default Browser"
UNKNOWN_PLATFORM = "unknown"

#: Endings and parts of a run of letters that mark a crawler or the address of a page about one, and whole tokens that do.
CRAWLER_ENDINGS = ["bot", "bots", "checker", "fetcher", "parser", "reader"]
CRAWLER_PARTS = ["blog", "crawl", "feed", "libwww", "robot", "spider", "verif"]
CRAWLER_WORDS = "http https www href link links mediapartners inspectiontool google-inspectiontool googleother googleagent google-safety duplexweb yandexdirect yandexfavicons anthropic-ai cohere-ai bingpreview whatsapp skypeuripreview"
#: Tokens of products that say nothing about the browser.
ENGINES = ["mozilla", "applewebkit", "gecko", "version", "mobile", "safari", "khtml"]

# Ranks: words before the products, the products, words behind them.
_EARLY, _PRODUCT, _LATE, _ROBOT = 0, 100, 200, 300


class _Words:
    """Rows (key, slot, rank, name, version, kind, platform, needs): what a word means, ranked as listed.

    `name` None is the agent's own spelling of the word. `version` is a word whose next token is meant (None: the
    word's own), or a value after "=". `needs` is another token that must be there.
    """

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, slot: str, rank: int, keys: str, name: str | None, version: str | None = None, kind: int = DESKTOP, platform: str = "", needs: str = "") -> None:
        for key in keys.split(","):
            self.rows.append((key, slot, rank + len(self.rows), name, version, kind, platform, needs))


def _table() -> list[tuple]:
    words = _Words()
    browser = lambda *a, **b: words.add("browser", _EARLY, *a, **b)
    late = lambda *a, **b: words.add("browser", _LATE, *a, **b)
    system = lambda *a, **b: words.add("platform", 0, *a, **b)

    # Names that results carry.
    for key, name in (("googlebot", "Googlebot"), ("slurp", "Yahoo! Slurp"), ("bingbot", "BingBot")):
        browser(key, name, kind=BOT)
    browser("feedburner", "FeedBurner", kind=READER)
    browser("wordpress-mu", "WordPress-mu", kind=READER)
    browser("wordpress", "WordPress", kind=READER)
    browser("opera mini", "Opera Mini", "mini", MOBILE)
    browser("opera mobile", "Opera Mobile", "mobile", MOBILE)
    browser("opr", "Opera")
    browser("opera", "Opera")
    for name in ("Camino", "Flock", "Galeon", "Orca", "Firefox", "Firebird"):
        browser(name.lower(), name)
    browser("edge 12.0", "IE", "=11")
    browser("edge", "IE", "=0")
    browser("trident", "IE", "rv", needs="rv")
    browser("iemobile", "IEMobile", platform="winphone8", kind=MOBILE, needs="msie")
    browser("iemobile", "IE Mobile", platform="wince", kind=MOBILE)
    for key, name in (("aol", "AOL"), ("america online", "AOL"), ("netscape", "Netscape"), ("crazy browser", "Crazy Browser"), ("avant", "Avant"), ("webtv", "MSNTV"), ("msntv", "MSNTV")):
        browser(key, name, needs="msie")
    browser("msie", "IE")
    for name in ("ELinks", "Lynx", "Emacs-w3m", "w3m", "ActiveWorlds", "Dillo", "OffByOne"):
        browser(name.lower(), name)
    late("netfront,nf-browser", "NetFront")
    for name in ("Bolt", "Iris", "Jasmine", "Minimo", "Novarra-Vision", "Polaris", "UP.Browser", "SMIT-Browser"):
        late(name.lower(), name)
    late("openwave", "OpenWave")
    late("obigo", "Obigo", "=")
    for key in ("alcatel amoi blackberry docomo htc ipaq kindle kwc lge lg mobilephone motorola nokia pda palm samsung sanyo smartphone sonyericsson t-mobile vodafone zte").split():
        late(key, None, "=", MOBILE)
    late("location.href,script,drop table,alter table", "Script Injection Bot", "=", BOT)
    for name in ("Nutch", "HTTrack", "WinHTTP"):
        late(name.lower(), name, kind=BOT)

    for release, name in (("10.0", "win10"), ("6.3", "win8.1"), ("6.2", "win8"), ("6.1", "win7"), ("6.0", "winvista"), ("5.2", "win2003"), ("5.1", "winxp"), ("5.0", "win2000")):
        if release == "10.0":
            system("nt 10.0", "wi10", kind=MOBILE, needs="touch")
        elif release == "6.3":
            system("nt 6.3", "winrt", needs="arm")
        if release in ("6.3", "6.2"):
            system(f"nt {release}", name, kind=MOBILE, needs="touch")
        system(f"nt {release}", name)
    system("windows 2000", "win2000")
    system("windows me", "winme")
    system("windows ce,win ce,wince,windowsce", "wince", kind=MOBILE)
    system("windows 98,win 98,win98,win 9x,windows98", "win98")
    system("windows 95,win 95,win95,windows95", "win95")
    system("windows 3.1,windows 3.11,win 3.1,win3.1,windows3.1", "win31")
    system("windows nt,winnt,win nt", "winnt")
    system("windows", UNKNOWN_PLATFORM)
    system("intel mac,ppc mac", "macosx")
    system("iphone,ipad", "ios", kind=MOBILE)
    system("os x", "macosx")
    system("android", "android", kind=MOBILE)
    system("beos,bepc,zeta", "beos")
    system("commodore 64,commodore64", "commodore64")
    system("darwin", "darwin")
    for name in ("freebsd", "openbsd", "netbsd"):
        system(name, name, version=name)
    system("xandros", "xandros")
    for name in ("centos debian fedora gentoo kanotix knoppix mandrake mandriva mepis pclinuxos slackware suse kubuntu xubuntu ubuntu linux").split():
        system(name, name)
    system("mac_powerpc,macintosh", "macppc")
    system("nintendo", "nintendo")
    system("ms-dos,msdos", "ms-dos")
    system("os 2", "os/2", needs="warp")
    system("palmos", "palmos", kind=MOBILE)
    for name in ("playstation", "irix", "solaris", "sunos"):
        system(name, name)
    system("symbianos", "symbianos", kind=MOBILE)
    system("zaurus", "zaurus", kind=MOBILE, needs="pda")
    system("sco_sv,unixware,unix", "unix")

    for key in CRAWLER_WORDS.split():
        words.add("crawler", 0, key, key)
    words.add("crawler", 0, "google favicon", "google")
    return words.rows


_COLUMNS = "key string, slot string, rank int, name string, version string, kind int, platform string, needs string"
_TOKEN = "[A-Za-z0-9][A-Za-z0-9._+!-]*"


def _crawls(text: Column) -> Column:
    """A run of letters that ends or is made like a crawler's name, or an address; a very short text too."""

    def one(t: Column) -> Column:
        found = F.lit(False)
        for ending in CRAWLER_ENDINGS:
            found = found | t.endswith(ending)
        for part in CRAWLER_PARTS:
            found = found | t.contains(part)
        return found

    return (F.length(text) <= 5) | text.contains("@") | F.exists(F.split(F.lower(text), "[^a-z]+"), one)


def _number(text: Column) -> Column:
    """The number that a version begins with, as text; 0 where there is none."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^[^0-9]?(\d+(?:\.\d+)?)", 1)
    return F.regexp_replace(F.coalesce(number.try_cast("double"), F.lit(0.0)).cast("string"), r"\.0$", "")


def _features(shown: Column) -> Column:
    """(at, key, cut) of each token, its leading letters (`cut` where a hyphen follows), and each token with the next."""
    low = F.transform(shown, F.lower)
    pairs = F.transform(low, lambda t, i: F.struct(i.alias("at"), F.concat_ws(" ", t, F.get(low, i + 1)).alias("key"), F.lit(False).alias("cut")))
    single = F.transform(low, lambda t, i: F.struct(i.alias("at"), t.alias("key"), F.lit(False).alias("cut")))
    letters = F.transform(low, lambda t, i: F.struct(i.alias("at"), F.regexp_extract(t, "^[a-z]*", 0).alias("key"), t.rlike("^[a-z]+-").alias("cut")))
    return F.array_distinct(F.concat(single, letters, pairs))


def _matched(agents: DataFrame) -> DataFrame:
    """One row per agent (agent_key, tokens) with its best words: browser, platform, crawler."""
    spark = agents.sparkSession
    words = spark.createDataFrame(_table(), _COLUMNS)
    cut = agents.withColumn("shown", F.regexp_extract_all("agent_key", F.lit(_TOKEN), F.lit(0))).withColumn("f", F.explode_outer(_features(F.col("shown"))))
    met = cut.select("agent_key", "shown", "f.*").join(words, "key", "left")
    low = F.transform("shown", F.lower)
    asked = F.coalesce(F.array_position(low, F.col("version")).cast("int") - 1, F.col("at"))
    version = F.when(F.startswith("version", F.lit("=")), F.substring("version", 2, 99)).otherwise(F.get("shown", asked + 1))
    fits = F.col("slot").isNotNull() & ((F.col("needs") == "") | F.array_contains(low, F.col("needs"))) & ~(F.col("cut") & (F.col("slot") == "browser") & (F.col("rank") < _PRODUCT))
    own = F.regexp_extract(F.get("shown", F.col("at")), "^[A-Za-z-]*", 0)
    answer = F.struct("rank", F.coalesce("name", own).alias("name"), version.alias("version"), "kind", "platform", F.col("version").isNotNull().alias("versioned"))
    best = lambda slot: F.min_by(F.when(fits & (F.col("slot") == slot), answer), F.when(fits & (F.col("slot") == slot), F.struct("rank", "at")))
    return met.groupBy("agent_key").agg(best("browser").alias("word"), best("platform").alias("system"), F.count(F.when(F.col("slot") == "crawler", 1)).alias("marks"))


def _answer(rank: int, name: Column, version: Column | None = None, kind: int = DESKTOP, platform: str = "") -> Column:
    version = F.lit("") if version is None else version
    return F.struct(F.lit(rank).alias("rank"), name.alias("name"), version.alias("version"), F.lit(kind).alias("kind"), F.lit(platform).alias("platform"))


def _by_products(text: Column, shown: Column, crawls: Column) -> Column:
    """The answer from the products, `name/version`, outside brackets; null where they say nothing."""
    tokens = F.transform(shown, F.lower)
    parts = F.filter(F.split(F.regexp_replace(text, r"\([^()]*\)", " "), " +"), lambda p: p != "")
    products = F.filter(parts, lambda p: p.contains("/"))
    name = lambda p: F.substring_index(p, "/", 1)
    version = lambda p: F.substring_index(p, "/", -1)
    has = lambda word: F.exists(products, lambda p: F.lower(name(p)) == word)
    of = lambda word: version(F.get(F.filter(products, lambda p: F.lower(name(p)) == word), F.lit(0)))
    after = lambda word: F.get(shown, F.nullif(F.array_position(tokens, word), F.lit(0)).cast("int"))
    own = F.filter(products, lambda p: ~F.lower(name(p)).isin(ENGINES))
    first, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
    behind = F.lower(name(F.get(products, F.size(products) - 1))) != "safari"
    unknown = F.lit(UNKNOWN_BROWSER)
    android = F.array_contains(tokens, "android")
    # a robot's product stands behind "compatible", or its name and version are all there is
    robot = after("compatible")
    alone = (F.size(parts) == 1) & (F.size(products) == 1)
    leading = F.get(products, F.lit(0))
    spelled = name(leading).rlike("^[A-Za-z_.]+$")
    return (
        F.when(has("gecko") & (F.size(own) > 0), _answer(_PRODUCT, name(first), version(first)))
        .when(has("gecko"), _answer(_PRODUCT, F.lit("Mozilla"), after("rv")))
        .when(has("applewebkit") & android & has("chrome"), _answer(_PRODUCT, F.lit("Chrome"), of("chrome")))
        .when(has("applewebkit") & android, _answer(_PRODUCT, unknown, of("version"), MOBILE, "android"))
        .when(has("applewebkit") & has("safari") & behind, _answer(_PRODUCT, unknown))
        .when(has("applewebkit") & (F.size(own) > 0), _answer(_PRODUCT, name(last), version(last)))
        .when(has("applewebkit"), _answer(_PRODUCT, unknown))
        .when(has("cfnetwork"), _answer(_ROBOT, name(leading), version(leading), BOT))
        .when(crawls & robot.isNotNull() & (F.lower(robot) != "mozilla"), _answer(_ROBOT, robot, after(F.lower(robot)), BOT))
        .when((crawls | alone) & spelled & (F.lower(name(leading)) != "mozilla"), _answer(_ROBOT, name(leading), version(leading), BOT))
    )


def describe(agents: DataFrame) -> DataFrame:
    """(agent_key, browser, browser_version, browser_type, platform, bot) of distinct texts `agent_key`; an empty or very short one is a crawler's."""
    text = F.col("agent_key")
    found = _matched(agents).withColumn("shown", F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))
    found = found.withColumn("bot", _crawls(text) | (F.col("marks") > 0))
    found = found.withColumn("product", _by_products(text, F.col("shown"), F.col("bot")))
    fields = ["rank", "name", "version", "kind", "platform"]
    word = F.when(F.col("word").isNotNull(), F.struct(*[F.col(f"word.{f}").alias(f) for f in fields]))
    nothing = _answer(_ROBOT, F.lit(UNKNOWN_BROWSER))
    chosen = F.when(F.col("product.rank") < F.coalesce(F.col("word.rank"), F.lit(_ROBOT + 1)), F.col("product")).otherwise(F.coalesce(word, F.col("product"), nothing))
    found = found.withColumn("chosen", F.when(F.length(text) <= 5, _answer(0, F.lit(UNKNOWN_BROWSER), kind=BOT)).otherwise(chosen))
    kind = F.when(F.col("bot"), BOT).otherwise(F.col("chosen.kind"))
    named = F.col("chosen.platform") != ""
    asked = ~named & (kind % 2 == 0)
    system = F.when(F.col("system.versioned") & F.col("system.version").rlike(r"^\d"), F.concat_ws(" ", "system.name", "system.version")).otherwise(F.coalesce("system.name", F.lit(UNKNOWN_PLATFORM)))
    return found.select(
        "agent_key",
        F.col("chosen.name").alias("browser"),
        _number(F.col("chosen.version")).alias("browser_version"),
        F.when(asked, F.greatest(kind, F.coalesce("system.kind", F.lit(DESKTOP)))).otherwise(kind).cast("int").alias("browser_type"),
        F.when(named, F.col("chosen.platform")).when(asked, system).otherwise(F.lit(UNKNOWN_PLATFORM)).alias("platform"),
        "bot",
    )


def _keyed(hits: DataFrame, agent: str) -> DataFrame:
    return hits.withColumn("agent_key", F.coalesce(as_column(agent), F.lit("")))


def flag_bots(hits: DataFrame, agent: str = "user_agent") -> DataFrame:
    """Add `bot`; every distinct agent is examined once."""
    keyed = _keyed(hits, agent)
    answers = describe(keyed.select("agent_key").distinct()).select("agent_key", "bot")
    return keyed.drop("bot").join(answers, "agent_key").select(*[c for c in hits.columns if c != "bot"], "bot")


def enrich_agents(hits: DataFrame, agent: str = "user_agent") -> DataFrame:
    """Add browser, browser_version, browser_type and platform; every distinct agent is examined once.

    The answers are joined back, a NULL agent as empty text. Adaptive execution broadcasts them when they are
    small and splits a hot agent when not.
    """
    fields = ["browser", "browser_version", "browser_type", "platform"]
    kept = [c for c in hits.columns if c not in fields]
    keyed = _keyed(hits.select(*kept), agent)
    answers = describe(keyed.select("agent_key").distinct()).select("agent_key", *fields)
    return keyed.join(answers, "agent_key").select(*kept, *fields)
