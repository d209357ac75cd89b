"""SQL building blocks shared by the check queries."""

from docketry.sources.orders import VENDORS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


VENDOR_VALUES = ", ".join(f"({i}, {quoted(v)})" for i, v in enumerate(VENDORS))
N_VENDORS = len(VENDORS)

PRICE = (
    "CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS DECIMAL(12,2)) * "
    "(CAST(1 AS DECIMAL(3,2)) - CAST(CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(3,2))), 2) "
    "AS DECIMAL(18,2))"
)

# receipts from the order tables: rec(order_key, custkey, vendor, d, items, subtotal, gst, total)
RECEIPTS = f"""
vend(vi, vendor) AS (VALUES {VENDOR_VALUES}),
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, p_name,
         {PRICE} AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
gathered AS (
  SELECT l_orderkey, sum(price) AS s,
         list({{'name': p_name, 'qty': CAST(l_quantity AS INTEGER), 'price': price}}
              ORDER BY l_linenumber, l_partkey, l_suppkey, price, l_quantity, l_shipdate, p_name)
           AS items
  FROM lines GROUP BY l_orderkey
),
rec0 AS (
  SELECT o_orderkey AS order_key, o_custkey AS custkey, o_orderpriority AS priority,
         o_orderdate AS ts, vendor, strftime(o_orderdate, '%Y-%m-%d') AS d,
         coalesce(items, []) AS items, CAST(coalesce(s, 0) AS DECIMAL(18,2)) AS subtotal
  FROM orders LEFT JOIN gathered ON o_orderkey = l_orderkey
  JOIN vend ON o_custkey % {N_VENDORS} = vi
),
rec1 AS (SELECT *, CAST(round(subtotal * 0.1, 2) AS DECIMAL(18,2)) AS gst FROM rec0),
rec AS (
  SELECT *, CAST(subtotal + gst AS DECIMAL(18,2)) AS total,
         array_to_string(list_transform(items, lambda i: i.name), ' ') AS names
  FROM rec1
),
txt AS (
  SELECT *, array_to_string(list_concat(
      [upper(vendor), 'Date: ' || d, '', 'Items:'],
      list_concat(
        list_transform(items, lambda i: i.name || ' - $' || CAST(i.price AS VARCHAR)),
        ['', 'Subtotal: $' || CAST(CAST(total - gst AS DECIMAL(18,2)) AS VARCHAR),
         'GST: $' || CAST(gst AS VARCHAR), 'Total: $' || CAST(total AS VARCHAR), '',
         'Thank you for your business!'])), chr(10)) AS receipt_text
  FROM rec
)"""



def gst_of(total: str) -> str:
    return f"(((CAST({total} * 100 AS BIGINT) * 2 + 11) // 22) / 100.0)"


def rules_values(rules: dict[str, list[str]]) -> str:
    return ", ".join(
        f"({c}, {quoted(category)}, {k}, {quoted(keyword)})"
        for c, (category, keywords) in enumerate(rules.items())
        for k, keyword in enumerate(keywords)
    )


def categorized(source: str, key: str, text: str, rules: dict[str, list[str]]) -> str:
    """CTEs ending in ``cat(key, category, n, keywords)`` for rows of ``source``."""
    return f"""
rules(cat_order, category, kw_order, keyword) AS (VALUES {rules_values(rules)}),
hits AS (
  SELECT {key}, cat_order, category, count(*) AS n,
         string_agg(keyword, ', ' ORDER BY kw_order) AS keywords
  FROM {source} JOIN rules ON contains({text}, lower(keyword))
  GROUP BY {key}, cat_order, category
),
cat AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, cat_order) AS rn FROM hits
  ) WHERE rn = 1
)"""


CLEAN = (
    "trim(regexp_replace(replace(regexp_replace(trim({t}, ' ' || chr(9) || chr(10) || chr(13)), "
    "'\\s+', ' ', 'g'), '|', ' '), '__+', ' ', 'g'))"
)


def clean(text: str) -> str:
    return CLEAN.format(t=text)


def normalized(cleaned: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({cleaned}), "
        f"'[^\\p{{L}}\\p{{N}}_\\s.,$]', '', 'g'), '\\s+', ' ', 'g'))"
    )
