"""Contracts made from the order tables, with faults planted by the order's key.

One document per order, rendered by Spark SQL: parties from customer and supplier,
a section per line item with its price, date and duration. A key divisible by one
of FAULTS breaks a rule, so what a validator must report follows from the tables
without reading the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Divisor of the order key: what goes wrong.
FAULTS = {
    7: "prices lack their currency",
    11: "items refer to an unknown section",
    13: "the second item repeats the first one's anchor",
    17: "the effective date is no date",
    19: "the seller's type is unknown",
    23: "the schedule is never mentioned",
    29: "the wrong term is used",
    31: "a placeholder changes its type",
    37: "the frontmatter is no YAML",
    41: "a heading skips levels and carries a number",
    43: "an unknown directive is used",
    47: "the buyer directive names nobody",
    53: "a field has no type",
}

ITEMS = """
SELECT l_orderkey, n, l_suppkey, concat_ws('\n',
  concat('## Item ', n, ' {#item-', CASE WHEN l_orderkey % 13 = 0 AND n = 2 THEN 1 ELSE n END, '}'), '',
  concat('Price {{money: ', cast(cast(l_extendedprice AS DECIMAL(18, 2)) AS STRING), CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE ', currency=USD' END, '}}, ',
         'shipped {{date: ', date_format(l_shipdate, 'yyyy-MM-dd'), '}}.'), '',
  concat('- Within {{duration: ', cast(cast(l_quantity AS INT) AS STRING), ', unit=', CASE WHEN l_orderkey % 5 = 1 THEN 'M' ELSE 'D' END, '}}'),
  concat('- See {{ref: ', CASE WHEN l_orderkey % 11 = 0 THEN 'nowhere' ELSE 'terms' END, '}}.'), '') AS body
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM {dealt})
"""

CONTRACTS = """
SELECT o_orderkey AS doc_id, concat('orders/', o_orderkey, '.lgd') AS file, concat(o_orderkey, '.lgd') AS filename, concat_ws('\n',
  '---',
  CASE WHEN o_orderkey % 37 = 0 THEN 'title: [unclosed' ELSE concat('title: Order ', o_orderkey) END,
  concat('effective_date: ', CASE WHEN o_orderkey % 17 = 0 THEN '2026-02-30' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END),
  'sides:', '  - name: buyers', '    parties:',
  concat('      - {name: c', c_custkey, ', type: legal_entity, legal_name: "', c_name, '"}'),
  '  - name: sellers', '    label: The Sellers', '    parties:',
  concat('      - {name: s', coalesce(l_suppkey, 0), ', type: ', CASE WHEN o_orderkey % 19 = 0 THEN 'corporation' ELSE 'legal_entity' END, '}'),
  'attachments:', '  - {id: schedule, title: Schedule, file: schedule.pdf}',
  '---', '', '# Terms {#terms}', '',
  concat('"Goods" {{def: goods}} means the items of order ', o_orderkey, '.'), '',
  concat('The buyer {{party: ', CASE WHEN o_orderkey % 47 = 0 THEN 'nobody' ELSE concat('c', c_custkey) END, '}} takes the {{term: ', CASE WHEN o_orderkey % 29 = 0 THEN 'wares' ELSE 'goods' END, '}} from the {{side: sellers}}.'), '',
  concat('Signed {{placeholder: sign-date, type=date}}', CASE WHEN o_orderkey % 31 = 0 THEN ' and {{placeholder: sign-date}}' ELSE '' END,
         CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE ', see {{attach: schedule}}' END, CASE WHEN o_orderkey % 43 = 0 THEN ' {{trem: goods}}' ELSE '' END,
         CASE WHEN o_orderkey % 53 = 0 THEN ' {{field: 5}}' ELSE '' END, '.'), '',
  body,
  CASE WHEN o_orderkey % 41 = 0 THEN '#### 1.2 Deep {#deep}\n\nEnd.' ELSE '' END) AS source
FROM {bought}
LEFT JOIN (SELECT l_orderkey, array_join(transform(sort_array(collect_list(struct(n, body))), x -> x.body), '\n') AS body, min_by(l_suppkey, n) AS l_suppkey
           FROM {items} GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""


#: Bytes of line items, as stored, that give a task's contracts: validation is work per byte of text, of which there is some twenty times as much.
TASK_BYTES = 1 << 20


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, filename, source): one document per order."""

    def named(name: str, rows: DataFrame) -> str:
        rows.createOrReplaceTempView(f"contracts_{name}")
        return f"contracts_{name}"

    lineitem, orders, customer = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer"))
    # Both sides are dealt by the order's key before they have text, into tasks that adaptive execution does not pack together: the text itself moves no more.
    size = int(lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    items = ITEMS.replace("{dealt}", named("lineitem", lineitem.repartition(tasks, "l_orderkey")))
    bought = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).repartition(tasks, "o_orderkey")
    query = CONTRACTS.replace("{items}", named("items", spark.sql(items))).replace("{bought}", named("bought", bought))
    return spark.sql(query)
