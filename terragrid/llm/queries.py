"""The registered query of each operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lm, mixing, near_dedup, pii, quality, token_counts, url_filter, warc
from .common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A third of the mixture from the largest source at most, some sources raised, all others as they come.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
PII_KEY = "terragrid-surrogates-1"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return out.withColumn("purity", F.round("purity", 9))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), PII_KEY, carry=["doc_id", "lang"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_dedup, op3_warc, op4_bpe, op5_token_counts, op6_mix_sources, op7_lm_score, op8_url_filter, op9_pii, op10_quality_rules)
}

_weights = ", ".join(f"('{s}', {w}::double)" for s, w in MIX_WEIGHTS.items())
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op6_mix_sources": f"""
        WITH w(source, weight) AS (VALUES {_weights}),
        d AS (SELECT doc_id, text, lang, documents.source, n_chars, coalesce(w.source, '') AS s,
                     coalesce(w.weight, 1 - (SELECT sum(weight) FROM w)) AS weight FROM documents LEFT JOIN w ON documents.source = w.source),
        r AS (SELECT *, (count(*) OVER ())::DOUBLE * weight / count(*) OVER (PARTITION BY s) AS rate FROM d),
        m AS (SELECT doc_id, unnest(range(0, (rate // {mixing.MOST_RATE})::BIGINT + 1)) AS part, rate FROM r),
        x AS (SELECT doc_id, CASE WHEN part = 0 THEN rate % {mixing.MOST_RATE} ELSE {mixing.MOST_RATE} END AS mean,
                     ('0x' || substr(md5(doc_id::VARCHAR || ':20260101' || CASE WHEN part > 0 THEN ':' || part::VARCHAR ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM m),
        p AS (SELECT mean, j, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) OVER (PARTITION BY mean ORDER BY j) AS c
              FROM (SELECT DISTINCT mean FROM x WHERE mean > 0), (SELECT unnest(range(0, 160))::DOUBLE AS j)),
        n AS (SELECT doc_id, count(*) AS copies FROM x JOIN p ON p.mean = x.mean AND p.c <= x.u GROUP BY doc_id),
        k AS (SELECT r.doc_id, text, lang, source, n_chars, copies FROM r JOIN n ON n.doc_id = r.doc_id)
        SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5(doc_id::VARCHAR || ':' || copy::VARCHAR || ':20260101') AS mix_key
        FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM k)""",
}


def _url_filter_sql(depth: int = 16) -> str:
    """The rules, and the template tree level by level. Levels below ``depth`` have no wildcards here (no path of the tables has so many)."""
    u = url_filter
    fits = lambda text: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*text.split("/", 1))
    by_length = sorted(URL_RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in by_length) + " END"
    fixed = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{k}'" for k, t in by_length) + " END"
    levels = "".join(
        f""",
        n{k} AS (SELECT host, tpl, count(*) >= {u.MANY_CHILDREN} AND max(n) < {u.TOP_SHARE}::DOUBLE * sum(n) AS wide
                 FROM (SELECT host, tpl, segs[{k}] AS seg, sum(n) AS n FROM t{k - 1} WHERE len(segs) >= {k} GROUP BY ALL) GROUP BY ALL),
        t{k} AS (SELECT host, segs, n, m, b, CASE WHEN len(segs) < {k} THEN tpl ELSE list_append(tpl, CASE WHEN wide THEN '*' ELSE segs[{k}] END) END AS tpl
                 FROM t{k - 1} LEFT JOIN n{k} USING (host, tpl))"""
        for k in range(1, depth + 1)
    )
    return f"""
        WITH p0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p0),
        p2 AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p1),
        p AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{8,}}(?:-[0-9a-fA-F]{{4,}})*', '*', 'g'), '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segs FROM p2),
        l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        t0 AS (SELECT host, segs, count(*) AS n, count(bad) AS m, coalesce(sum(bad), 0) AS b, []::VARCHAR[] AS tpl FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host, segs){levels},
        t AS (SELECT host, segs, m, b, list_concat(tpl, segs[{depth + 1}:]) AS tpl FROM t{depth}),
        leaf AS (SELECT host, tpl, sum(m)::DOUBLE AS m, sum(b)::DOUBLE AS b FROM t GROUP BY host, tpl),
        step AS (SELECT host, tpl, m, b, list_append(list_transform(tpl, lambda s: '/' || s), 'end') AS marks FROM leaf),
        node AS (SELECT host, tpl, m, b, k AS level, marks[1:k] AS node, CASE WHEN k > 0 THEN marks[1:k - 1] END AS parent FROM step, unnest(range(0, len(marks) + 1)) AS r(k)),
        total AS (SELECT host, node, parent, sum(m) AS m, sum(b) AS b FROM node GROUP BY host, node, parent),
        r0 AS (SELECT c.host, c.node, c.parent, c.m, c.b, q.m - c.m AS om, q.b - c.b AS ob FROM total c JOIN total q ON q.host = c.host AND q.node = c.parent),
        r1 AS (SELECT *, (ob + b + 1) / (om + m + 2) AS pooled FROM r0),
        r2 AS (SELECT *, m = 0 OR om = 0 OR abs(b / greatest(m, 1) - ob / greatest(om, 1)) <= {u.SIMILAR_Z} * sqrt(pooled * (1 - pooled) * (1 / greatest(m, 1) + 1 / greatest(om, 1))) AS merged FROM r1),
        pool AS (SELECT host, parent AS top, sum(m) AS mm, sum(b) AS bb FROM r2 WHERE merged GROUP BY host, parent),
        held AS (SELECT node.host, tpl, max(level) AS level FROM node JOIN r2 ON r2.host = node.host AND r2.node = node.node WHERE NOT merged GROUP BY node.host, tpl),
        top AS (SELECT step.host, step.tpl, m, b, marks[1:coalesce(level, 0)] AS top FROM step LEFT JOIN held ON held.host = step.host AND held.tpl = step.tpl),
        rated AS (SELECT host, (sum(b) + {u.PRIOR} * (SELECT sum(b) / (sum(m) + 1) FROM leaf)) / (sum(m) + {u.PRIOR}) AS hrate FROM leaf GROUP BY host),
        r AS (SELECT top.host, tpl, (coalesce(bb, b) + {u.PRIOR} * hrate) / (coalesce(mm, m) + {u.PRIOR}) AS purity
              FROM top JOIN rated ON rated.host = top.host LEFT JOIN pool ON pool.host = top.host AND pool.top = top.top)
        SELECT page_id, p.host, path, {rule.replace("host", "p.host")} AS rule, coalesce({fixed.replace("host", "p.host")}, CASE WHEN purity >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
               CASE WHEN len(t.tpl) > 0 THEN '/' || array_to_string(t.tpl, '/') ELSE '' END AS template, round(purity, 9) AS purity
        FROM p JOIN t ON t.host = p.host AND t.segs = p.segs JOIN r ON r.host = t.host AND r.tpl = t.tpl"""


ORACLE_SQL["op8_url_filter"] = _url_filter_sql()
