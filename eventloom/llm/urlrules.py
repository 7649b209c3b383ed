"""URL filters: listed rules first, then association rules mined by FP-growth; built-in functions only.

A listed rule (host, path, verdict) fits its host and all subdomains if the
url's path starts with the rule's; the longest wins. Urls without one are
judged by mined rules.

Mining: a url is the set of its words (``h:`` host, ``p:`` path, ``q:`` what
follows; A-Z lower-cased, a number is ``#``). Each distinct labelled url counts
once per label, with an item of its own if it is to be blocked; Spark's
FP-growth gives the frequent sets. A set of words is a rule if it stands with
that item in ``SUPPORT`` of the transactions (``LEAST`` at least) and these are
``CONFIDENCE`` of those that have the set; a rule that contains another rule is
redundant and goes. A set of n words has 2 ** n subsets, so the words of a url
with over ``WINDOW`` of them are cut into transactions of that many, in order;
combinations are mined within one, while matching looks at all words of a url.

Matching: an inverted index lists each rule under its rarest word. Distinct
urls look up their words, those that no rule has fall away, and the listed
candidates are verified against what is left. A very common url is looked up
once, a very common word only meets the rules for which it is the rarest.

Defined cases: a null url, or one without ``://``, has an empty host, an empty
path and no words, and is allowed; a url without path fits no rule (paths start
with ``/``); rows without a label are not learnt from; repeated rows count once
in mining and are judged each; long urls are taken whole; of rules of equal
length the one first in text order wins; an empty table gives an empty result;
columns other than those named are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query, table
from eventloom.llm.text import lowered, write_read
from eventloom.session import shared_dir

# Fixed values of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SUPPORT = 0.001
LEAST = 10
CONFIDENCE = 0.6
WINDOW = 12
BLOCKED = "=block"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_url(url: Column | str) -> tuple[Column, Column, Column]:
    """(host, path, what follows) as columns."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    mark = F.instr(text, "://")
    after = F.when(mark > 0, F.substring(text, mark + 3, F.char_length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    behind = F.substring(after, F.char_length(host) + 1, F.char_length(after))
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    return lowered(host), path, F.substring(behind, F.char_length(path) + 1, F.char_length(behind))


def words(url: Column | str) -> Column:
    """Sorted distinct words of a url, marked by the part they stand in."""

    def of(part: Column, mark: str) -> Column:
        found = F.regexp_extract_all(lowered(part), F.lit(WORD), F.lit(0))
        return F.transform(found, lambda w: F.concat(F.lit(f"{mark}:"), F.when(F.rlike(w, F.lit("^[0-9]+$")), "#").otherwise(w)))

    host, path, rest = split_url(url)
    return F.array_sort(F.array_distinct(F.concat(of(host, "h"), of(path, "p"), of(rest, "q"))))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    known = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in ordered])

    def fits(r: Column) -> Column:
        return ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])

    first = F.get(F.filter(known, fits), F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def transactions(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", window: int = WINDOW) -> DataFrame:
    """(items, blocked): the words of each distinct labelled url, at most ``window`` in a row."""
    own = labelled.select(F.col(url_col).alias("url"), F.col(blocked_col).cast("boolean").alias("blocked")).where("url IS NOT NULL AND blocked IS NOT NULL")
    own = own.distinct().select("blocked", words("url").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / window).cast("int"))
    return own.select("blocked", F.explode(F.transform(starts, lambda k: F.slice("w", k * window + 1, F.lit(window)))).alias("items"))


def mine(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", support: float = SUPPORT, least: int = LEAST,
         confidence: float = CONFIDENCE, window: int = WINDOW) -> DataFrame:
    """(words, n, n_blocked, confidence): the rules, none containing another."""
    spark = labelled.sparkSession
    base = shared_dir(spark, "urlrules")
    marked = F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items"))
    baskets = write_read(transactions(labelled, url_col, blocked_col, window).select(marked.alias("items")), f"{base}/baskets")
    count = baskets.count()
    wanted = max(least, math.ceil(support * count))
    if wanted > count:
        return spark.createDataFrame([], "words array<string>, n long, n_blocked long, confidence double")
    # FP-growth takes the ceiling of share times rows.
    model = FPGrowth(itemsCol="items", minSupport=(wanted - 0.5) / count).fit(baskets)
    sets = write_read(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), f"{base}/sets")
    blocked = F.array_contains("items", BLOCKED)
    both = sets.where(blocked & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("words"), F.col("freq").alias("n_blocked"))
    rules = both.join(sets.where(~blocked).select(F.col("items").alias("words"), F.col("freq").alias("n")), "words")
    rules = rules.withColumn("confidence", F.col("n_blocked") / F.col("n")).where(F.col("confidence") >= confidence)
    rules = write_read(rules.select("words", "n", "n_blocked", "confidence"), f"{base}/rules")
    # A rule is redundant if a rule of fewer words is part of it.
    own = matches(rules.select(F.col("words").alias("key"), "words"), rules)
    least_words = own.select(F.col("key").alias("words"), F.array_min(F.transform("rules", lambda r: F.size(r["words"]))).alias("fewest"))
    return write_read(rules.join(least_words, "words").where(F.size("words") == F.col("fewest")).drop("fewest"), f"{base}/minimal")


def inverted(rules: DataFrame) -> DataFrame:
    """(word, rules): every word of a rule, with the rules for which it is the rarest."""
    own = rules.select(F.explode("words").alias("word"), "words", "confidence", "n")
    common = own.groupBy("word").agg(F.max("n").alias("seen"))
    rarest = own.join(common, "word").groupBy("words", "confidence").agg(F.min(F.struct("seen", "word")).alias("first"))
    posted = rarest.groupBy(F.col("first.word").alias("word")).agg(F.collect_list(F.struct("words", "confidence")).alias("rules"))
    none = F.array().cast("array<struct<words:array<string>,confidence:double>>")
    return common.select("word").join(posted, "word", "left").select("word", F.coalesce("rules", none).alias("rules"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rules): the rules whose words a row (key, words) has; keys are distinct, rows without a rule are left out."""
    met = urls.select("key", F.explode("words").alias("word")).join(inverted(rules), "word")
    met = met.groupBy("key").agg(F.collect_list("word").alias("own"), F.flatten(F.collect_list("rules")).alias("listed"))
    return met.select("key", F.filter("listed", lambda r: F.forall(r["words"], lambda w: F.array_contains("own", w))).alias("rules")).where(F.size("rules") > 0)


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, confidence): a listed rule's verdict, else ``block`` where a mined rule matches, with the best one's confidence."""
    host, path, _ = split_url("url")
    own = pages.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    own = own.withColumn("given", listed(F.col("host"), F.col("path"), rules))
    asked = own.where("given IS NULL AND host <> ''").select("url").distinct()
    found = matches(asked.select(F.col("url").alias("key"), words("url").alias("words")), mined)
    best = found.select(F.col("key").alias("url"), F.array_max(F.transform("rules", lambda r: r["confidence"])).alias("best"))
    joined = own.join(best, "url", "left")
    return joined.select(
        F.col(id_col), "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce(F.col("given.verdict"), F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("best")).alias("confidence"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages whose id is labelled, to be blocked if toxic or of low quality."""
    own = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return pages.select("page_id", "url").join(own, "page_id").select("url", "blocked")


SQL = rf"""
WITH a AS (
  SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS behind FROM a),
c AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(behind, '^[^?#]*') AS path FROM b),
d AS (
  SELECT page_id, url, host, path, list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all(host, '{WORD}'), lambda w: 'h:' || CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '#' ELSE w END),
    list_transform(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'),
      lambda w: 'p:' || CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '#' ELSE w END),
    list_transform(regexp_extract_all(translate(substr(behind, length(path) + 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'),
      lambda w: 'q:' || CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '#' ELSE w END)))) AS words
  FROM c),
l AS (
  SELECT DISTINCT url, words, toxic = 1 OR quality = 0 AS blocked FROM d JOIN labels ON page_id = doc_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL AND url IS NOT NULL),
t AS (
  SELECT row_number() OVER () AS tid, blocked, items
  FROM (SELECT blocked, unnest(list_transform(range(0, (len(words) + {WINDOW - 1}) // {WINDOW}), lambda k: words[k * {WINDOW} + 1:k * {WINDOW} + {WINDOW}])) AS items FROM l)),
need AS (SELECT greatest({LEAST}, ceil({SUPPORT} * count(*))) AS n FROM t),
often AS (SELECT list(item) AS items FROM (SELECT unnest(items) AS item, blocked FROM t) WHERE blocked GROUP BY item HAVING count(*) >= (SELECT n FROM need)),
o AS (SELECT flatten(list(items)) AS items FROM often),
k AS (SELECT blocked, list_filter(t.items, lambda x: list_contains(o.items, x)) AS items FROM t, o),
sub AS (
  SELECT blocked, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT blocked, items, unnest(range(1, 1 << len(items))) AS m FROM k)),
r AS (
  SELECT s, count_if(blocked) / count(*) AS confidence FROM sub GROUP BY s
  HAVING count_if(blocked) >= (SELECT n FROM need) AND count_if(blocked) / count(*) >= {CONFIDENCE}),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS x WHERE len(x.s) < len(r.s) AND list_has_all(r.s, x.s))),
g(rhost, rpath, v) AS (VALUES {", ".join(map(str, RULES))}),
f AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM d JOIN g ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
h AS (SELECT page_id, max(confidence) AS best FROM d JOIN m ON list_has_all(words, s) GROUP BY page_id)
SELECT d.page_id, host, path, f.rule, coalesce(f.v, CASE WHEN h.best IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.rule IS NULL THEN h.best END AS confidence
FROM d LEFT JOIN f ON d.page_id = f.page_id LEFT JOIN h ON d.page_id = h.page_id
"""


@query("op12_urlrules", SQL)
def op12_urlrules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(labelled_pages(pages, table(spark, sf_dir, "labels"))), RULES)
