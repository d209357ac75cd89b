"""Damaged conversations, repaired."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.conversation_repair import conversation_repair
from docketry.llm.frames import table


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the damage that the hash of their place says, and ``copies``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = (
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    )
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair(damaged(rows), copies="copies")


_SPACE = r"\x20\x09-\x0D"


def _edit(letter: str, cost: str, line: str | None) -> str:
    text = "e.text" if line is None else f"e.text || CASE WHEN e.text = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'cost': e.cost + {cost}, 'audit': e.audit || '{letter}', 'text': {text}}}"


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _from(state: str, value: str, when: str = "true") -> str:
    """``value`` over the best way ``e`` into a state, where that is possible."""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN list_transform([{state}], lambda e: {value})[1] END"


def _step(turn: str) -> str:
    """The best ways into each state after a turn, from those before it."""
    stays, more = f"{turn}.fault NOT IN ('blank', 'duplicate')", f"(CASE WHEN {turn}.fault = 'truncated' THEN 3 ELSE 0 END)"
    kept = f"{turn}.role || ':' || {turn}.said"

    def into(name: str, froms: tuple[str, ...], initial: str, role: str | None) -> str:
        ways = [_from(f"s.{name}", _edit("D", "4", None))]
        for start in froms:
            ways.append(_from(f"s.{start}", _edit("K", more, kept), f"{stays} AND {turn}.initial = '{initial}'"))
            if role:
                ways.append(_from(f"s.{start}", _edit("R", f"3 + {more}", f"'{role}:' || {turn}.said"), stays))
        return f"'{name}': {_best(*ways)}"

    system = _best(
        _from("s.n", _edit("K", more, kept), f"{stays} AND {turn}.initial = 's'"),
        _from("s.s", _edit("D", "4", None)),
    )
    return (
        f"{{'n': {_from('s.n', _edit('D', '4', None))}, 's': {system}, "
        f"{into('u', ('n', 's', 'a'), 'u', 'user')}, {into('a', ('u',), 'a', 'assistant')}}}"
    )


def _inserts() -> str:
    """The same with one more insert allowed."""
    user = _best("s.u", *(_from(f"s.{f}", _edit("I", "3", "'user:'")) for f in ("n", "s", "a")))
    other = _best("s.a", _from("s.u", _edit("I", "3", "'assistant:'")))
    return f"{{'n': s.n, 's': s.s, 'u': {user}, 'a': {other}}}"


_WAY = "STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR)"

#: Walks all conversations turn by turn, with the cheapest way into each state, ties
#: by the audit; the hash of a row's place is CRC-32 bit by bit.
SQL = rf"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 1, 2, 3, 4, 5, 6, 7]),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM conversations
), kinds AS (
  SELECT *, xor(crc, 4294967295) % 20 AS kind FROM rows
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(said), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, said ORDER BY turn NULLS FIRST, copy) AS seen,
         CASE WHEN role = '' THEN ' ' ELSE role[1] END AS initial,
         regexp_replace(said, '[{_SPACE}]+$', '') AS trimmed
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'role': role, 'said': said, 'initial': initial, 'fault': fault}} ORDER BY i) AS turns
  FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, turns, 1 AS i, {{'n': {{'cost': 0, 'audit': '', 'text': ''}}::{_WAY},
         's': NULL::{_WAY}, 'u': NULL::{_WAY}, 'a': NULL::{_WAY}}} AS s, false AS ready, 0 AS inserted
  FROM counted
  UNION ALL
  SELECT conv_id, turns, CASE WHEN inserted < 2 THEN i ELSE i + 1 END,
         CASE WHEN inserted < 2 THEN {_inserts()}
              ELSE list_transform([turns[i]], lambda t: {_step("t")})[1] END,
         inserted = 1 AND i > len(turns), (inserted + 1) % 3
  FROM walk WHERE NOT ready
), repaired AS (
  SELECT conv_id, {_best("s.n", "s.a")} AS best FROM walk WHERE ready
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
