"""URL filters: host and path rules first, then logistic regression on hashed n-grams.

Everything is DataFrame functions and the DataFrame API of pyspark.ml (JVM side).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule): the rule's host up to its first slash, then its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The small labelled table to learn from, invented for this purpose: what is to be blocked ...
BLOCKED = (
    "http://casino-palace.example/slots/free-spins", "https://www.royal-casino.example/bonus/welcome", "http://m.poker-night.example/tables/holdem",
    "https://jackpot-city.example/play", "http://roulette-online.example/en/bet", "https://sportsbetting-tips.example/odds/today",
    "http://bet365-mirror.example/register", "https://slots4u.example/de/spielen", "http://blackjack-live.example/dealer", "https://lucky-gambling.example/fr/4411.html",
    "http://bingo-bets.example/games?ref=88", "https://lotto-jackpot.example/ticket/buy",
    "http://free-porn-clips.example/watch/1187", "https://xxx-movies.example/hd/22", "http://sex-chat-now.example/rooms", "https://www.adult-cams.example/live",
    "http://nude-models.example/gallery/5", "https://hot-milfs.example/videos", "http://escort-service.example/city/paris", "https://adultdating.example/join",
    "http://hentai-porn.example/list", "https://erotic-stories.example/es/331", "http://webcam-sex.example/private", "https://pornhub-free.example/en/991",
    "http://sexshop-deals.example/toys", "https://strip-cams.example/girls/online", "http://adult-videos-free.example/18plus", "https://naked-girls.example/pics/77.html",
    "http://buy-viagra-cheap.example/order", "https://cialis-pharmacy.example/no-prescription", "http://diet-pills-fast.example/lose-weight", "https://xanax-online.example/buy",
    "http://cheap-meds.example/pills/generic", "https://steroids-shop.example/cart", "http://miracle-weight-loss.example/offer", "https://canadian-pharmacy.example/viagra?aff=3",
    "http://replica-rolex.example/watches", "https://fake-handbags.example/gucci/sale", "http://cheap-replica-bags.example/outlet", "https://counterfeit-sneakers.example/yeezy",
    "http://payday-loans-now.example/apply", "https://instant-cash-loan.example/bad-credit", "http://fast-loan-approval.example/no-check", "https://get-rich-quick.example/secret",
    "http://make-money-online.example/from-home", "https://crypto-doubler.example/send-btc", "http://bitcoin-giveaway.example/claim", "https://forex-profit-signals.example/join",
    "http://free-iphone-winner.example/claim-prize", "https://you-won-gift-card.example/survey", "http://survey-rewards.example/win", "https://free-gift-cards.example/generator",
    "http://warez-download.example/cracked/photoshop", "https://torrent-movies.example/magnet/9912", "http://keygen-serials.example/crack.exe", "https://nulled-scripts.example/download",
    "http://cracked-apk-mods.example/free", "https://pirate-streams.example/watch/free", "http://free-serial-keys.example/activator",
    "http://secure-paypal-login.example/verify/account", "https://account-update-bank.example/signin/confirm.php", "http://appleid-verify.example/unlock", "https://login-microsoft-alert.example/password/reset",
    "http://virus-alert-support.example/call-now", "https://your-pc-infected.example/scan.exe", "http://free-antivirus-scan.example/download/setup.exe",
    "http://ads.clicknet.example/serve/banner?id=7", "https://adserver.example/popunder/12", "http://ad-exchange.example/click?aff=9", "https://track.adclicks.example/redirect?url=1",
    "http://banner-ads.example/impression/81", "https://popads-network.example/tag.js", "http://sponsored-ads.example/offer/4", "https://adtracker.example/pixel.gif?c=2",
    "http://affiliate-ads.example/go/442", "https://doubleads.example/adframe.html", "http://cpa-offers.example/track/aff/77", "https://promo-ads.example/fr/9123",
    "http://buy-backlinks.example/seo/cheap", "https://link-farm.example/directory/spam", "http://instagram-followers-buy.example/likes", "https://spam-bot.example/mass-mail",
    "http://essay-writing-cheap.example/order-now", "https://fake-diploma.example/buy/degree", "http://cheap-cigarettes.example/shop", "https://hacked-accounts.example/netflix/free",
    "http://ddos-booter.example/stresser", "https://buy-weed-online.example/strains", "http://gore-videos.example/shock", "https://click-here-now.example/win/free",
)
#: ... and what is not.
ALLOWED = (
    "http://www.city-library.example/catalogue/history", "https://museum.example/exhibitions/2019/bronze-age", "http://news.harbour.example/2021/05/council-vote", "https://physics.university.example/lectures/quantum/3",
    "http://garden-notes.example/roses/pruning", "https://recipes.kitchen.example/soups/lentil", "http://blog.hiking.example/trails/north-ridge", "https://weather.region.example/forecast/tuesday",
    "http://www.parliament.example/debates/1998/march", "https://court.example/opinions/114", "http://docs.compiler.example/manual/install.html", "https://wiki.example/wiki/Volcano",
    "http://forum.linux.example/thread/8812?page=2", "https://maps.coast.example/tides", "http://birds.example/species/heron", "https://astronomy.example/articles/nebula",
    "http://chess-club.example/games/1972/6", "https://music-school.example/violin/beginners", "http://m.railway.example/timetable/winter", "https://health.ministry.example/guides/vaccines",
    "http://www.hospital.example/patients/visiting", "https://farmers-market.example/apples", "http://bakery.example/sourdough/starter", "https://theatre.example/programme/hamlet",
    "http://poetry-archive.example/authors/keats", "https://language.institute.example/grammar/verbs", "http://teaching.maths.example/algebra/rings", "https://data.statistics.example/tables/population.html",
    "http://local-history.example/mills/waterwheel", "https://geology.example/rocks/basalt", "http://chemistry.example/elements/iron", "https://biology.example/cells/mitosis",
    "http://www.school.example/calendar/term2", "https://kindergarten.example/parents/letters", "http://fire-brigade.example/safety/chimneys", "https://sailing-club.example/regatta/results",
    "http://football-league.example/fixtures/march", "https://cycling.example/routes/alps", "http://www.cinema.example/programme/friday", "https://film-institute.example/archive/silent",
    "http://cathedral.example/architecture/nave", "https://town-hall.example/services/passports", "http://water-utility.example/tariffs", "https://energy.agency.example/solar/panels",
    "http://open.source.example/releases/notes", "https://database.example/docs/indexes/btree", "http://python-users.example/tutorials/lists", "https://network.example/protocols/tcp",
    "http://adaptive-optics.example/papers/2004", "https://adventure-books.example/authors", "http://academy.example/admissions", "https://administration.example/forms/tax",
    "http://track-and-field.example/results/100m", "https://trackbed.example/gauge/narrow", "http://essex.example/villages", "https://sussex-downs.example/walks",
    "http://alphabet.example/letters/greek", "https://betony.example/herbs", "http://spinning-wool.example/wheels", "https://slotcar-museum.example/models",
    "http://www.anthology.example/en/7002", "https://m.thunder.example/es/18113/", "http://blog.winter.example/fr/40117?utm_source=feed", "https://www.station.example/de/5521#top",
    "http://northern.example/en/9911/", "https://blog.theory.example/fr/30071.html", "http://m.tension.example/en/61190", "https://www.thermal.example/de/7710.html",
    "http://m.harvest.example/es/2209?page=2&ref=x", "https://meadow.example/en/40501/", "http://www.lantern.example/fr/66102.html", "https://blog.orchard.example/de/771#top",
    "http://m.river.example/es/9112", "https://www.stone.example/en/88231.html", "http://heath.example/de/1042/", "https://m.valley.example/fr/3310?utm_source=feed",
    "http://letters.example/1850/index.html", "https://diary.example/january", "http://philosophy.example/ethics/kant", "https://economics.example/trade/tariffs",
    "http://insects.example/beetles/stag", "https://fishing-port.example/catch/herring", "http://glassworks.example/furnace", "https://pottery.example/glazes/ash",
    "http://knitting.example/patterns/socks", "https://carpentry.example/joints/dovetail", "http://beekeeping.example/hives/spring", "https://veterinary.example/sheep/lambing",
    "http://www.observatory.example/telescopes/8m", "https://seismology.example/quakes/2011", "http://translation.example/glossary", "https://dictionary.example/entries/oak",
    "http://radio.example/schedule/evening", "https://orchestra.example/concerts/mahler", "http://paintings.example/landscape/17th-century", "https://archive.example/maps/1740",
)
LABELLED = (*((1, url) for url in BLOCKED), *((0, url) for url in ALLOWED))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one overrides
        own, slash, below = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + below))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longer(grams: Column, chars: Column, n: int) -> Column:
    """From all (n - 1)-grams of the characters all n-grams, in one walk."""
    count = F.greatest(F.lit(0), F.size(chars) - (n - 1))
    return F.zip_with(F.slice(grams, F.lit(1), count), F.slice(chars, F.lit(n), count), lambda x, y: F.concat(x, y))


def ngrams(host: Column, path: Column) -> Column:
    """Character 3- and 4-grams of ``host`` (marked) and of ``path`` with digits folded to 0; linear in the length."""

    def grams(text: Column, mark: str) -> Column:
        def both(chars: Column) -> Column:
            threes = _longer(_longer(chars, chars, 2), chars, 3)
            marked = _let(threes, lambda x: F.concat(x, _longer(x, chars, 4)))
            return F.transform(marked, lambda x: F.concat(F.lit(mark), x))

        return _let(F.split(text, ""), both)

    return F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(F.lower(F.regexp_replace(path, "[0-9]+", "0")), "p"))


def train(spark: SparkSession, labelled: tuple[tuple[int, str], ...] = LABELLED, features: int = 1 << 14, penalty: float = 2e-5) -> PipelineModel:
    """Fit the classifier; ``labelled``: a small table of (1 to block or 0, URL)."""
    values = ", ".join("({}D, '{}')".format(y, u.replace("\\", "\\\\").replace("'", "\\'")) for y, u in labelled)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, url)")
    host, path = split_url(F.col("url"))
    table = table.coalesce(1).select("label", ngrams(host, path).alias("grams"))
    hashing = HashingTF(inputCol="grams", outputCol="counts", numFeatures=features, binary=True)
    counts = hashing.transform(table)
    rare = IDF(inputCol="counts", outputCol="rare").fit(counts)  # what all URLs have says nothing
    even = Normalizer(inputCol="rare", outputCol="features")  # a long URL weighs no more than a short one
    regression = LogisticRegression(maxIter=100, regParam=penalty, standardization=False, probabilityCol="probability")
    return PipelineModel([hashing, rare, even, regression.fit(even.transform(rare.transform(counts)))])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: PipelineModel | None = None, threshold: float = 0.65) -> DataFrame:
    """Judge every URL: ``page_id, url, host, path, rule, verdict, block_score``.

    A rule's verdict holds; else the classifier's: block from ``threshold`` on. A URL that is
    null, empty or without ``://`` has an empty host and path, fits no rule with a host, and
    has nothing to judge: score 0, allow. Repeated rows are judged alike, very long URLs whole
    in time linear in their length; an empty table gives an empty result; extra columns are
    ignored.
    """
    from pyspark.ml.functions import vector_to_array

    model = model or train(pages.sparkSession)
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("grams", ngrams(F.col("host"), F.col("path")))
    scored = model.transform(rows)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    score = F.when((F.col("host") == "") & (F.col("path") == ""), 0.0).otherwise(vector_to_array("probability")[1])
    return scored.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
