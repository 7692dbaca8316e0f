"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table: distinct n-grams of host and path,
each hashed to a slot, are its features.  Weights are kept as whole millionths, so that
sums don't depend on their order.  Features of the training table and of every page come
from the same DataFrame expressions; only the table's slots (MAX_LABELLED rows at most) go to the driver to be fitted.

A null url, or one without `://`, has an empty host and path, fits no rule and is judged by the
model like any other.  Repeated rows are judged each for themselves, extra columns don't matter.
"""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.licences import lowered

SLOTS, GRAM, EPOCHS, RATE, RIDGE, MAX_LABELLED = 4096, 4, 60, 0.5, 1e-3, 10_000
UNIT = 1_000_000

#: Verdict, host and path of the rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The labelled URL table; unwanted ones.
UNWANTED = """
http://casino-win.example.com/en/12 http://www.casino-royal.example.net/slots/spin.html https://free-casino-bonus.example.org/play/ http://m.slots-online.example.com/jackpot/free
https://poker-win.example.net/bets/today http://www.poker-cash.example.org/tables/21 https://sports-bets.example.com/odds/live http://free-bets.example.net/de/7.html
http://bets-today.example.org/fr/3/ https://lucky-jackpot.example.com/win/money http://www.cheap-pills.example.com/en/450 https://cheap-pills.example.net/order/now
http://online-pharmacy.example.org/pills/order https://pharmacy-no-prescription.example.com/cheap/meds http://www.diet-pills.example.net/buy/cheap https://buy-meds.example.org/pills/blue
http://adult-x.example.com/videos/free https://xxx-adult.example.net/cams/live http://www.adult-cams.example.org/free/videos https://hot-adult-video.example.com/xxx/88
http://ads-track.example.net/click?id=1 https://click-track.example.org/ads/banner http://banner-ads.example.com/pop/under https://ad-click.example.net/track/pixel.gif
http://payday-loans.example.org/apply/free https://fast-loans.example.com/cash/now http://www.quick-cash.example.net/loans/apply https://loans-no-check.example.org/apply/today
http://spam-farm.example.org/en/728 https://link-farm.example.com/buy/links http://www.buy-links.example.net/seo/cheap https://seo-spam.example.org/links/free
http://free-money.example.com/win/now https://win-prize.example.net/claim/free http://www.claim-prize.example.org/winner/1 https://you-win.example.com/prize/claim
http://replica-watches.example.net/cheap/buy https://cheap-replica.example.org/bags/buy http://www.fake-watches.example.com/sale/cheap https://replica-bags.example.net/sale/now
http://free-download-crack.example.org/keygen/serial https://crack-serial.example.com/download/free http://www.keygen-free.example.net/crack/7 https://warez-download.example.org/free/full
http://work-from-home.example.com/cash/fast https://earn-cash-fast.example.net/money/now http://www.fast-money.example.org/earn/home https://get-rich.example.com/money/fast
http://dating-hot-singles.example.net/join/free https://hot-singles.example.org/adult/join http://www.singles-cams.example.com/live/free https://meet-singles.example.net/hot/now
""".split()
#: The labelled URL table; wanted ones.
WANTED = """
http://garden-news.example.org/en/12 https://www.garden-guide.example.net/plants/roses.html https://city-library.example.com/books/new http://m.library-catalog.example.org/authors/poe
https://open-science.example.net/papers/2041 http://www.science-daily.example.com/physics/waves https://river-guide.example.org/maps/north http://trail-guide.example.net/de/7.html
http://history-notes.example.com/fr/3/ https://www.history-museum.example.org/collection/rome https://www.thenews.example.org/en/2041.html https://morning-news.example.com/world/today
http://blog.weather.example.net/en/77/ https://weather-report.example.org/city/paris http://www.local-weather.example.com/forecast/week https://docs.python.example.org/library/functions
https://docs.spark.example.com/guide/sql http://www.code-notes.example.net/articles/sorting https://developer-blog.example.org/posts/cache https://university.example.net/courses/physics
http://www.university.example.com/faculty/history https://math-courses.example.org/lectures/algebra https://museum.example.org/collection/paintings http://art-museum.example.net/exhibits/spring
https://recipes.example.net/bread/sourdough http://www.family-recipes.example.com/soup/tomato https://kitchen-notes.example.org/articles/knives http://baking-guide.example.net/cakes/lemon
https://bird-watch.example.org/species/owl http://www.nature-notes.example.com/forest/birds https://wildlife-trust.example.net/reserves/north http://park-rangers.example.org/maps/trails
https://health-service.example.com/advice/sleep http://www.hospital.example.org/departments/children https://public-health.example.net/reports/2020 http://clinic-guide.example.com/visits/first
https://city-council.example.org/meetings/minutes http://www.town-hall.example.net/services/parking https://tax-office.example.com/forms/income http://voter-guide.example.org/districts/map
https://train-times.example.net/stations/central http://www.bus-lines.example.com/routes/42 https://bike-share.example.org/docks/list http://airport-guide.example.net/gates/terminal
https://chess-club.example.com/games/openings http://www.football-club.example.org/matches/report https://running-notes.example.net/training/plan http://swim-club.example.com/lessons/children
https://book-reviews.example.org/fiction/new http://www.film-notes.example.net/reviews/drama https://music-school.example.com/lessons/piano http://choir-concerts.example.org/spring/program
""".split()
LABELLED = [*[(u, 1) for u in UNWANTED], *[(u, 0) for u in WANTED]]


def host(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def slots(host_: Column, path_: Column) -> Column:
    """Sorted distinct slots of the character n-grams of host and path."""

    def grams(text: Column) -> Column:
        # slices of one split are zipped: a lambda over places would split anew at each
        n = F.greatest(F.length(text) - (GRAM - 1), F.lit(1))
        chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        shifted = F.arrays_zip(*[F.slice(chars, F.lit(k + 1), n) for k in range(GRAM)])
        return F.when(
            F.length(text) >= GRAM, F.transform(shifted, lambda z: F.concat(*[z[str(k)] for k in range(GRAM)]))
        ).otherwise(F.array(text))

    both = F.concat(grams(F.concat(F.lit("h:"), host_, F.lit("/"))), grams(F.concat(F.lit("p:"), path_)))
    return F.array_sort(F.array_distinct(F.transform(both, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))))


def slots_of(host_: str, path_: str) -> list[int]:
    """The same in plain Python, for the SQL text."""
    out = set()
    for text in (f"h:{host_}/", f"p:{path_}"):
        for i in range(max(1, len(text) - GRAM + 1)):
            out.add(int(hashlib.md5(text[i : i + GRAM].encode()).hexdigest()[:3], 16))
    return sorted(out)


def parts_of(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL, in plain Python."""
    host_, rest = url.split("://", 1)[1].split("/", 1)
    return host_.lower(), "/" + rest.split("?")[0].split("#")[0]


def held_out_accuracy(folds: int = 5) -> float:
    """Share of the labelled table judged right by models trained without its fold."""
    right = 0
    for k in range(folds):
        known = [(slots_of(*parts_of(u)), y) for i, (u, y) in enumerate(LABELLED) if i % folds != k]
        weights, bias = train(sorted(known))
        for u, y in LABELLED[k::folds]:
            found = slots_of(*parts_of(u))
            right += (sum(weights[s] for s in found) / math.sqrt(len(found)) + bias > 0) == bool(y)
    return right / len(LABELLED)


def train(rows: list[tuple[list[int], int]]) -> tuple[list[int], int]:
    """Weights and bias in millionths, by gradient steps over the rows in order; no rows give a model that allows all."""
    weight, bias = [0.0] * SLOTS, -0.5
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 10)
        for found, label in rows:
            z = bias + sum(weight[s] for s in found) / math.sqrt(len(found))
            step = rate * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += 0.1 * step
            for s in found:
                weight[s] += step / math.sqrt(len(found)) - rate * RIDGE * weight[s]
    return [round(w * UNIT) for w in weight], round(bias * UNIT)


def fit(labelled: DataFrame) -> tuple[list[int], int]:
    """A model from labelled (url, label); rows with a null label teach nothing."""
    u = F.col("url").cast("string")
    rows = labelled.filter("label IS NOT NULL").select(slots(host(u), path(u)).alias("s"), F.col("label").cast("int").alias("y"), host(u).alias("h"), path(u).alias("p"))
    rows = rows.orderBy("h", "p", "y").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    return train([(list(r.s), r.y) for r in rows])


def judge(pages: DataFrame, model: tuple[list[int], int], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, score; score: the model's chance that the url is unwanted."""
    weights, bias = model
    # one constant, folded by the optimizer
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is put in front
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    found = rows.withColumn("slots", slots(F.col("host"), F.col("path")))
    total = F.aggregate("slots", F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(table, s))
    margin = total / F.sqrt(F.size("slots").cast("double")) + F.lit(float(bias))
    found = found.withColumn("margin", margin)
    return found.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(1 / (1 + F.exp(-F.col("margin") / UNIT)), 6).alias("score"),
    )


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for the judgement of the pages table by a model from LABELLED."""
    rows = sorted((*parts_of(u), y) for u, y in LABELLED)
    weights, bias = train([(slots_of(h, p), y) for h, p, y in rows])
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in by_length) + " END"
    grams = lambda t: f"CASE WHEN length({t}) >= {GRAM} THEN list_transform(range(1, greatest(length({t}) - {GRAM - 2}, 2)), lambda i: substr({t}, i, {GRAM})) ELSE [{t}] END"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
grams AS (SELECT *, list_concat({grams("('h:' || host || '/')")}, {grams("('p:' || path)")}) AS g FROM parts),
slots AS (SELECT * EXCLUDE g, list_distinct(list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 3))::INT)) AS s FROM grams),
model AS (SELECT [{",".join(map(str, weights))}] AS w),
scored AS (SELECT slots.* , list_sum(list_transform(s, lambda x: w[x + 1]))::DOUBLE / sqrt(len(s)::DOUBLE) + {float(bias)} AS margin FROM slots, model)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  round(1 / (1 + exp(-margin / {UNIT})), 6) AS score
FROM scored"""
