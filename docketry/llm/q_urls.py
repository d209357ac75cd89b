"""Verdicts over all pages."""

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.frames import table
from docketry.llm.url_filter import (
    CRITICAL, DEPTH, MIN_PAGES, MIN_SHARE, PRIOR, RULES, filter_urls,
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity"
    )


def _rules() -> str:
    cases = []
    for rule, says in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        cases.append(
            f"WHEN (host = '{name}' OR ends_with(host, '.{name}'))"
            f" AND starts_with(path, '{slash}{start}') THEN ['{rule}', '{says}']"
        )
    return " ".join(cases)


def _differs(part: str, of: str, all_part: str, all_of: str) -> str:
    share = f"(all_{all_part} / all_{all_of})"
    off = f"({part} / {of} - {share})"
    return (
        f"coalesce({off} * {off} * {of} > {CRITICAL}::DOUBLE * {share} * (1.0::DOUBLE - {share}), false)"
    )


def _level(n: int) -> str:
    return f"""
, branch{n} AS (
  SELECT host, template, segs[{n + 1}] AS seg, sum(pages) AS n, sum(labelled) AS k,
         sum(blocked) AS b, sum(CASE WHEN len(segs) = {n + 1} THEN pages ELSE 0.0 END) AS e
  FROM tree{n} WHERE len(segs) > {n} GROUP BY ALL
), node{n} AS (
  SELECT host, template, sum(n) AS all_n, sum(k) AS all_k, sum(b) AS all_b, sum(e) AS all_e
  FROM branch{n} GROUP BY ALL
), kept{n} AS (
  SELECT host, template, seg FROM branch{n} JOIN node{n} USING (host, template)
  WHERE n >= {MIN_PAGES} AND n >= {MIN_SHARE}::DOUBLE * all_n
    AND (CASE WHEN k > 0 THEN {_differs("b", "k", "b", "k")} ELSE false END
         OR {_differs("e", "n", "e", "n")})
), tree{n + 1} AS (
  SELECT t.* REPLACE (CASE WHEN len(segs) <= {n} THEN t.template
                      ELSE t.template || '/' || CASE WHEN kept.seg IS NULL THEN '*'
                                                ELSE kept.seg END END AS template)
  FROM tree{n} t LEFT JOIN kept{n} kept
    ON t.host = kept.host AND t.template = kept.template AND t.segs[{n + 1}] = kept.seg
)"""


SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {_rules()} END AS found FROM parsed
), judged AS (
  SELECT page_id, host, path, found[1] AS rule, found[2] AS says,
         string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/') AS parts FROM ruled
), shaped AS (
  SELECT *, array_to_string(list_concat(parts[2:{DEPTH + 1}],
         CASE WHEN len(parts) > {DEPTH + 1} THEN ['**'] ELSE []::VARCHAR[] END), '/') AS shape
  FROM judged
), tree0 AS (
  SELECT host, shape, '' AS template, string_split(shape, '/') AS segs,
         count(*)::DOUBLE AS pages, count(says)::DOUBLE AS labelled,
         count(CASE WHEN says = 'block' THEN 1 END)::DOUBLE AS blocked
  FROM shaped GROUP BY host, shape
){"".join(_level(n) for n in range(DEPTH + 1))}
, prior AS (
  SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0.0 END AS prior
  FROM tree{DEPTH + 1}
), pure AS (
  SELECT host, template,
         (sum(blocked) + {PRIOR}::DOUBLE * prior) / (sum(labelled) + {PRIOR}::DOUBLE) AS purity
  FROM tree{DEPTH + 1}, prior GROUP BY host, template, prior
)
SELECT s.page_id, s.host, s.path, s.rule,
       coalesce(s.says, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, purity
FROM shaped s JOIN tree{DEPTH + 1} t ON s.host = t.host AND s.shape = t.shape
JOIN pure p ON p.host = t.host AND p.template = t.template
"""
