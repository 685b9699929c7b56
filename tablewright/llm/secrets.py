"""Secrets in texts, told apart by who else has them.

Patterns find candidates with their places, in code points. Every candidate's value is
hashed, and the whole corpus says in how many repositories, and with how many owners, the
hash occurs: a value that many owners carry is a widely copied example, one that stays with
a few is a live-looking credential. Long runs of mixed characters without a keyword beside
them are far too common to report by their looks; they are reported only if the ownership
says live. All of it is DataFrame functions.

Defined results: a null text is empty; a null source is a repository (and owner) of its own
named ''; rows with equal or null ids are each answered for themselves; columns other than
the id, text and source are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import kept, stored, text_of

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: a run that is too short is dropped whole, so asking for the length is the same
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
#: kinds in the order in which spans at one place are listed
KINDS = ["assign", "access", "hex", "mixed"]
BASE = KINDS[:3]
SPAN = "array<struct<start:int,rank:int,stop:int,hash:string>>"
#: a value with more owners (or in more repositories) than this is an example
MAX_OWNERS = 2
MAX_REPOSITORIES = 3


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Places of all matches: what lies between matches and the matches, in turn, give them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        value = F.regexp_extract(part["match"], pattern, group) if group else part["match"]
        begin = acc["at"] + F.length(part["between"])
        stop = begin + F.length(part["match"])
        span = F.struct(
            begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.md5(value).alias("hash")
        )
        keep = part["match"].isNotNull() & (F.length(value) >= least)
        return F.struct(
            F.coalesce(stop, begin).alias("at"),
            F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPAN).alias("spans"),
        )

    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["spans"]).otherwise(F.array().cast(SPAN))


def _mixed(text: Column) -> Column:
    """Runs with capitals, small letters and digits in them."""
    several = r"(?=[^0-9]*+[0-9])(?=[^A-Z]*+[A-Z])(?=[^a-z]*+[a-z])"
    runs = F.regexp_extract_all(text, F.lit(MIXED), F.lit(0))
    return F.when(text.rlike(MIXED) & F.exists(runs, lambda r: r.rlike("^" + several)), _found(text, MIXED, "mixed")).otherwise(
        F.array().cast(SPAN)
    )


def _with_spans(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``docs`` with ``_body``, ``_repository``, and the ``_base`` and ``_added`` candidates."""
    looks = lambda m: F.substring(F.col("_tw_body"), m["start"] + 1, m["stop"] - m["start"])
    body = F.col("_tw_body")
    return (
        docs.withColumn("_tw_body", text_of(text))
        .withColumn("_tw_repository", F.coalesce(F.col(source).cast("string"), F.lit("")))
        .withColumn(
            "_tw_base",
            F.array_sort(
                F.concat(_found(body, ASSIGN, "assign", 2, 8), _found(body, ACCESS, "access"), _found(body, HEX, "hex"))
            ),
        )
        .withColumn("_tw_mixed", _mixed(body))
        .withColumn(
            "_tw_added",
            F.filter(
                "_tw_mixed",
                lambda m: looks(m).rlike("[0-9]") & looks(m).rlike("[A-Z]") & looks(m).rlike("[a-z]")
                & ~F.exists("_tw_base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])),
            ),
        )
        .drop("_tw_mixed")
    )


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: id, repository, ``base`` and ``added`` candidate spans."""
    only = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    return _with_spans(only, "text", "source").select(
        "doc_id", F.col("_tw_repository").alias("repository"), F.col("_tw_base").alias("base"), F.col("_tw_added").alias("added")
    )


def example_hashes(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Hashes that more than so many owners or repositories carry.

    The owner is what stands before a slash in the repository's name, or the whole name.
    Each step counts per task before it shuffles, so a value in a third of all rows is a
    few rows by then.
    """
    each = found.select("repository", F.explode(F.concat("base", "added")).alias("span"))
    owned = each.select(
        F.col("span.hash").alias("hash"), F.substring_index("repository", "/", 1).alias("owner"), "repository"
    ).distinct()
    by_owner = owned.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return (
        by_owner.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
        .where((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
        .select("hash")
    )


def judged(found: DataFrame, keys: list[str], **limits: int) -> DataFrame:
    """``found`` with ``examples``: which of a row's hashes are widely copied."""
    examples = stored(example_hashes(found, **limits))
    each = found.select(*keys, F.explode(F.concat("base", "added")).alias("span")).select(
        *keys, F.col("span.hash").alias("hash")
    )
    per_row = each.join(examples, "hash").groupBy(*keys).agg(F.collect_set("hash").alias("examples"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition &= more
    return found.alias("f").join(per_row.alias("e"), condition, "left").select(
        "f.*", F.coalesce("e.examples", F.array().cast("array<string>")).alias("examples")
    )


def _is_live(span: Column) -> Column:
    return ~F.array_contains(F.col("examples"), span["hash"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **limits: int) -> DataFrame:
    """A row per document: id, ``base`` spans, and ``spans`` (base and added live ones) with
    kind, start, stop (code points, stop exclusive), the value's hash and ``live``."""
    found = kept(candidates(docs, id, text, source).withColumn("row", F.monotonically_increasing_id()))
    rows = judged(found, ["row"], **limits).withColumn(
        "all", F.array_sort(F.concat("base", F.filter("added", _is_live)))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    return rows.select(
        "doc_id",
        "base",
        "all",
        F.transform(
            "all",
            lambda s: F.struct(
                F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                s["hash"].alias("hash"), _is_live(s).alias("live"),
            ),
        ).alias("spans"),
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find_secrets`."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact_secrets(docs: DataFrame, mark: str = "<secret>", **limits: int) -> DataFrame:
    """The documents with every live secret's span replaced by ``mark``.

    Widely copied examples stay, and so do all rows and columns; ``n_chars`` follows the
    text if there is such a column. Documents without candidates pass through untouched and
    unshuffled; only those with some are joined, by id, with the examples among theirs.
    """
    marked = _with_spans(docs, "text", "source")
    some = F.size(F.concat("_tw_base", "_tw_added")) > 0
    found = kept(
        marked.where(some).select(
            "doc_id", F.col("_tw_repository").alias("repository"), F.col("_tw_base").alias("base"), F.col("_tw_added").alias("added")
        )
    )
    examples = stored(example_hashes(found, **limits))
    per_id = (
        found.select(F.col("doc_id").alias("_tw_id"), F.explode(F.concat("base", "added")).alias("span"))
        .join(examples, F.col("span.hash") == F.col("hash"))
        .groupBy("_tw_id")
        .agg(F.collect_set("hash").alias("_tw_examples"))
    )
    live = F.array_sort(
        F.filter(
            F.concat("_tw_base", "_tw_added"),
            lambda s: ~F.array_contains(F.coalesce("_tw_examples", F.array().cast("array<string>")), s["hash"]),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("_tw_body"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["parts"], F.array(before, F.lit(mark)))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"),
        )

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("_tw_body"), acc["at"] + 1, F.length("_tw_body")))

    suspects = (
        marked.where(some)
        .join(per_id, marked["doc_id"].eqNullSafe(F.col("_tw_id")), "left")
        .withColumn("_tw_live", live)
        .withColumn("text", F.when(F.size("_tw_live") > 0, F.aggregate("_tw_live", start, cut, rest)).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        suspects = suspects.withColumn("n_chars", F.when(F.size("_tw_live") > 0, length).otherwise(F.col("n_chars")))
    return suspects.select(*docs.columns).unionByName(marked.where(~some).select(*docs.columns))


def _matches_sql(kind: str, pattern: str, group: int = 0) -> str:
    value = f"regexp_extract(m[i], '{pattern}', {group})" if group else "m[i]"
    return f"""SELECT r, {KINDS.index(kind)} AS rank, {value} AS val, length(m[i]) AS n,
      list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
    FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))"""


_SQL_ASSIGN = ASSIGN.replace("'", "''")
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT r, rank, val, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM (
    SELECT * FROM ({_matches_sql("assign", _SQL_ASSIGN, 2)}) WHERE length(val) >= 8
    UNION ALL {_matches_sql("access", ACCESS)}
    UNION ALL {_matches_sql("hex", HEX)})
), mixed AS (
  SELECT r, rank, val, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM ({_matches_sql("mixed", MIXED)}) x
  WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.start < x.start + x.n AND x.start < b.stop)
), found AS (SELECT * FROM base UNION ALL SELECT * FROM mixed),
live AS (
  SELECT val FROM found JOIN d USING (r) GROUP BY val
  HAVING count(DISTINCT split_part(repo, '/', 1)) <= {MAX_OWNERS} AND count(DISTINCT repo) <= {MAX_REPOSITORIES}
), named AS (
  SELECT f.*, l.val IS NOT NULL AS is_live,
    (['assign', 'access', 'hex', 'mixed'])[rank + 1] || ':' || start || ':' || stop AS label
  FROM found f LEFT JOIN live l USING (val)
)
SELECT d.doc_id,
  count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(label, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(label, ',' ORDER BY start, rank) FILTER (WHERE rank < 3 OR is_live), '') AS spans,
  count(*) FILTER (WHERE is_live) AS n_live, count(*) FILTER (WHERE rank < 3 AND NOT is_live) AS n_example
FROM d LEFT JOIN named n ON d.r = n.r GROUP BY d.r, d.doc_id
"""
