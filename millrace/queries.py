"""Named queries over the test tables, each a program of the language, with DuckDB SQL that says the same.

Rows: the program runs for every row of its table. Whole: its input is the array of all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.api import interpret, query, query_all, run_documents
from millrace.sources.readers import rows_as_json


@dataclass(frozen=True)
class Query:
    table: str
    program: str
    sql: str | None
    whole: bool = False
    tables: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    #: columns to read, where a generic row would read more
    columns: tuple[str, ...] = field(default=())
    mode: str = "native"
    #: other tables as a selection of their columns
    renamed: dict[str, str] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        load = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df = load(self.table)
        df = df.select(*self.columns) if self.columns else df
        if self.whole:
            others = {t: spark.sql(self.renamed[t], **{t: load(t)}) if t in self.renamed else load(t) for t in self.tables}
            return query_all(df, self.program, tables=others, order=self.order, mode=self.mode)
        return query(df, self.program, mode=self.mode)


def rows(table: str, program: str, sql: str, **more) -> Query:
    return Query(table, program, sql, **more)


def whole(table: str, program: str, sql: str, **more) -> Query:
    return Query(table, program, sql, whole=True, **more)


QUERIES: dict[str, Query] = {
    # filters and projections
    "select_eq": rows("events", 'select(.event_type == "purchase") | {user_id, value}', "SELECT user_id, value FROM events WHERE event_type = 'purchase'"),
    "select_compound": rows("lineitem", 'select(.l_returnflag == "R" and .l_quantity > 40) | {l_orderkey, l_linenumber, l_quantity}', "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"),
    "select_or": rows("orders", 'select(.o_orderstatus == "F" or .o_totalprice >= 300000) | .o_orderkey', "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'F' OR o_totalprice >= 300000"),
    "select_test": rows("part", 'select(.p_name | test("a.*e")) | {p_partkey, p_name}', "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'a.*e')"),
    "select_startswith": rows("part", 'select((.p_brand | startswith("Brand#1")) and (.p_type | endswith("L") | not)) | .p_partkey', "SELECT p_partkey AS value FROM part WHERE starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_type, 'L')"),
    "select_contains": rows("documents", 'select(.text | contains("\\n")) | .doc_id', "SELECT doc_id AS value FROM documents WHERE contains(text, chr(10))"),
    "field": rows("customer", ".c_name", "SELECT c_name AS value FROM customer"),
    "project": rows("orders", "{o_orderkey, total: .o_totalprice}", "SELECT o_orderkey, o_totalprice AS total FROM orders"),
    "project_array": rows("nation", "[.n_nationkey, .n_regionkey] | add", "SELECT (n_nationkey + n_regionkey)::BIGINT AS value FROM nation"),
    "pick": rows("supplier", "pick(.s_suppkey, .s_name)", "SELECT s_suppkey, s_name FROM supplier"),
    "del": rows("supplier", "del(.s_acctbal)", "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "rename_merge": rows("region", '. + {r_name: (.r_name | ascii_downcase), size: (.r_name | length)}', "SELECT r_regionkey, lower(r_name) AS r_name, len(r_name) AS size FROM region"),
    "update_field": rows("supplier", ".s_acctbal |= floor", "SELECT s_suppkey, s_name, s_nationkey, floor(s_acctbal)::BIGINT AS s_acctbal FROM supplier"),
    "update_arith": rows("part", ".p_size += 1 | {p_partkey, p_size}", "SELECT p_partkey, (p_size + 1)::BIGINT AS p_size FROM part"),
    "assign_new": rows("nation", '.label = "\\(.n_name):\\(.n_nationkey)"', "SELECT *, n_name || ':' || n_nationkey AS label FROM nation"),
    "del_keys": rows("region", "del(.r_name) | keys | length", "SELECT 1::BIGINT AS value FROM region"),
    # scalars
    "if_else": rows("events", '{event_id, size: (if .value > 100 then "high" elif .value > 10 then "mid" else "low" end)}', "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS size FROM events"),
    "alternative": rows("labels", "{doc_id, toxic: (.toxic // -1), bad: (.quality == 0 // false)}", "SELECT doc_id, coalesce(toxic, -1)::BIGINT AS toxic, coalesce(quality = 0, false) AS bad FROM labels"),
    "arith": rows("lineitem", "{l_orderkey, l_linenumber, net: (.l_extendedprice * (1 - .l_discount))}", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "modulo": rows("orders", "{o_orderkey, shard: (.o_orderkey % 7), half: (.o_orderkey / 2)}", "SELECT o_orderkey, o_orderkey % 7 AS shard, o_orderkey / 2 AS half FROM orders"),
    "math": rows("part", "{p_partkey, root: (.p_size | sqrt), up: (.p_retailprice | ceil), rounded: (.p_retailprice | round), lg: (.p_retailprice | log2 | . * 1000 | floor)}", "SELECT p_partkey, sqrt(p_size) AS root, ceil(p_retailprice)::BIGINT AS up, round(p_retailprice)::BIGINT AS rounded, floor(log2(p_retailprice) * 1000)::BIGINT AS lg FROM part"),
    "trigonometry": rows("part", "def millionths: . * 1e6 | round; {p_partkey, s: (.p_size | sin | millionths), c: (.p_size | cos | millionths), t: (.p_size | atan | millionths), p: pow(.p_size; 2)}", "SELECT p_partkey, round(sin(p_size) * 1e6)::BIGINT AS s, round(cos(p_size) * 1e6)::BIGINT AS c, round(atan(p_size) * 1e6)::BIGINT AS t, pow(p_size, 2) AS p FROM part"),
    "compare_all": rows("labels", "{doc_id, lt: (.toxic < .quality), ge: (.toxic >= .quality), ne: (.toxic != .quality)}", "SELECT doc_id, CASE WHEN toxic IS NULL THEN quality IS NOT NULL WHEN quality IS NULL THEN false ELSE toxic < quality END AS lt, CASE WHEN quality IS NULL THEN true WHEN toxic IS NULL THEN false ELSE toxic >= quality END AS ge, toxic IS DISTINCT FROM quality AS ne FROM labels"),
    "logic": rows("lineitem", '{l_orderkey, l_linenumber, odd: ((.l_quantity > 25 and .l_discount < 0.05) or .l_returnflag == "A" | not)}', "SELECT l_orderkey, l_linenumber, NOT ((l_quantity > 25 AND l_discount < 0.05) OR l_returnflag = 'A') AS odd FROM lineitem"),
    "bind": rows("lineitem", ".l_quantity as $q | .l_tax as $t | {l_orderkey, l_linenumber, x: ($q * $t)}", "SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS x FROM lineitem"),
    "destructure": rows("orders", '. as {o_orderkey: $k, o_totalprice: $p} | {k: $k, p: ($p - 1)}', "SELECT o_orderkey AS k, o_totalprice - 1 AS p FROM orders"),
    "define": rows("lineitem", "def net(d): .l_extendedprice * (1 - d); def taxed($t): net(.l_discount) * (1 + $t); {l_orderkey, l_linenumber, v: taxed(.l_tax)}", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS v FROM lineitem"),
    "types": rows("labels", "{doc_id, t: (.toxic | type)}", "SELECT doc_id, CASE WHEN toxic IS NULL THEN 'null' ELSE 'number' END AS t FROM labels"),
    # strings
    "strings": rows("customer", "{c_custkey, up: (.c_name | ascii_upcase), n: (.c_mktsegment | length), bytes: (.c_name | utf8bytelength), part: .c_name[3:9]}", "SELECT c_custkey, upper(c_name) AS up, len(c_mktsegment) AS n, strlen(c_name) AS bytes, substr(c_name, 4, 6) AS part FROM customer"),
    "trim_strings": rows("nation", '{n_nationkey, l: (.n_name | ltrimstr("NATION")), r: (.n_name | rtrimstr("1")), t: ("  \\(.n_name) " | trim)}', "SELECT n_nationkey, CASE WHEN starts_with(n_name, 'NATION') THEN substr(n_name, 7) ELSE n_name END AS l, CASE WHEN ends_with(n_name, '1') THEN left(n_name, len(n_name) - 1) ELSE n_name END AS r, n_name AS t FROM nation"),
    "split_join": rows("part", '{p_partkey, words: (.p_name | split(" ") | length), dashed: (.p_name | split(" ") | join("-"))}', "SELECT p_partkey, len(string_split(p_name, ' ')) AS words, replace(p_name, ' ', '-') AS dashed FROM part"),
    "replace_pattern": rows("part", '{p_partkey, v: (.p_name | gsub("[aeiou]+"; "_"))}', "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS v FROM part"),
    "index_string": rows("customer", '{c_custkey, i: (.c_name | index("#")), last: (.c_name | rindex("0")), all: (.c_name | indices("0") | length)}', "SELECT c_custkey, nullif(instr(c_name, '#'), 0) - 1 AS i, CASE WHEN contains(c_name, '0') THEN len(c_name) - instr(reverse(c_name), '0') END AS last, len(c_name) - len(replace(c_name, '0', '')) AS all FROM customer"),
    "capture": rows("customer", '{c_custkey, n: (.c_name | capture("#0*(?<digits>[1-9][0-9]*)") | .digits)}', "SELECT c_custkey, nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)', 1), '') AS n FROM customer"),
    "template": rows("orders", '"\\(.o_orderkey)/\\(.o_orderstatus)"', "SELECT o_orderkey || '/' || o_orderstatus AS value FROM orders"),
    "formats": rows("nation", '{n_nationkey, b: (.n_name | @base64), h: ("<\\(.n_name)&" | @html), csv: ([.n_name, "a\\"b"] | @csv), sh: ([.n_name] | @sh)}', "SELECT n_nationkey, base64(encode(n_name)) AS b, '&lt;' || n_name || '&amp;' AS h, '\"' || n_name || '\",\"a\"\"b\"' AS csv, '''' || n_name || '''' AS sh FROM nation"),
    "uri": rows("pages", "{page_id, u: (.url | @uri)}", "SELECT page_id, url_encode(url) AS u FROM pages"),
    "base64_round_trip": rows("pages", "select((.url | @base64 | @base64d) == .url) | .page_id", "SELECT page_id AS value FROM pages"),
    "dates": rows("orders", '{o_orderkey, day: (.o_orderdate | strftime("%Y-%m-%d")), iso: (.o_orderdate | todate), month: (.o_orderdate | gmtime | .[1])}', "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, (month(o_orderdate) - 1)::BIGINT AS month FROM orders"),
    "epoch": rows("events", "{event_id, at: (.event_id * 3600 | todate), back: (.event_id * 3600 | todate | fromdate)}", "SELECT event_id, strftime(make_timestamp(event_id * 3600 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, event_id * 3600 AS back FROM events"),
    "json_number": rows("events", "{event_id, k: (.props | fromjson | .k | tonumber)}", "SELECT event_id, (props->>'k')::DOUBLE AS k FROM events"),
    "json_filter": rows("events", "select((.props | fromjson | .k) > 90) | {event_id, k: (.props | fromjson | .k | tostring)}", "SELECT event_id, props->>'k' AS k FROM events WHERE (props->>'k')::DOUBLE > 90"),
    # arrays in a row
    "array_sum_squares": rows("embeddings", "{vec_id, s: (.embedding | map(. * .) | add)}", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings"),
    "array_filter": rows("embeddings", "{vec_id, n: ([.embedding[] | select(. > 0)] | length)}", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings"),
    "array_slice": rows("embeddings", "{vec_id, first: .embedding[0], last: .embedding[-1], n: (.embedding[2:-1] | length), x: (.embedding | any(. > 2)), y: (.embedding | all(. < 3))}", "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, len(embedding) - 3 AS n, list_max(embedding) > 2 AS x, list_max(embedding) < 3 AS y FROM embeddings"),
    "array_order": rows("embeddings", "{vec_id, lo: (.embedding | min), hi: (.embedding | max), mid: (.embedding | sort | .[3]), far: (.embedding | max_by(fabs))}", "SELECT vec_id, list_min(embedding) AS lo, list_max(embedding) AS hi, list_sort(embedding)[4] AS mid, list_reverse_sort(list_transform(embedding, lambda x: {'a': abs(x::DOUBLE), 'x': x}))[1].x AS far FROM embeddings"),
    "array_reduce": rows("embeddings", "{vec_id, m: (reduce .embedding[] as $x (0; if $x > . then $x else . end))}", "SELECT vec_id, greatest(0, list_max(embedding))::DOUBLE AS m FROM embeddings"),
    "range_map": rows("region", "{r_regionkey, t: ([range(.r_regionkey + 1) | . * .] | add)}", "SELECT r_regionkey, list_sum([x * x FOR x IN range(r_regionkey + 1)])::BIGINT AS t FROM region"),
    # one to many
    "explode": rows("embeddings", "{vec_id, v: .embedding} | .vec_id as $id | .v[] | select(. > 0) | {id: $id, v: .}", "SELECT vec_id AS id, v FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) WHERE v > 0"),
    "splits": rows("part", '.p_name | splits(" +")', "SELECT unnest(regexp_split_to_array(p_name, ' +')) AS value FROM part"),
    "scan": rows("customer", '.c_name | scan("[0-9]+")', "SELECT unnest(regexp_extract_all(c_name, '[0-9]+')) AS value FROM customer"),
    "comma": rows("nation", ".n_nationkey, .n_regionkey", "SELECT n_nationkey AS value FROM nation UNION ALL SELECT n_regionkey FROM nation"),
    "range": rows("region", "range(.r_regionkey)", "SELECT unnest(range(r_regionkey)) AS value FROM region"),
    "empty_select": rows("nation", "if .n_regionkey > 2 then .n_name else empty end", "SELECT n_name AS value FROM nation WHERE n_regionkey > 2"),
    # whole tables
    "length": whole("lineitem", "length", "SELECT count(*) AS value FROM lineitem"),
    "group_count": whole("events", "group_by(.event_type) | map({k: .[0].event_type, n: length})", "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1"),
    "group_sum": whole("lineitem", "group_by(.l_returnflag, .l_linestatus) | map({flag: .[0].l_returnflag, status: .[0].l_linestatus, qty: (map(.l_quantity) | add), n: length, top: (map(.l_extendedprice) | max), parts: (map(.l_partkey) | unique | length)})", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, count(*) AS n, max(l_extendedprice) AS top, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2"),
    "group_having": whole("orders", "group_by(.o_custkey) | map(select(length > 15) | {c: .[0].o_custkey, n: length, late: (map(select(.o_orderstatus == \"O\")) | length)})", "SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS late FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "group_average": whole("part", "group_by(.p_brand) | map({brand: .[0].p_brand, mean: ((map(.p_size) | add) / length)})", "SELECT p_brand AS brand, sum(p_size) / count(*) AS mean FROM part GROUP BY 1"),
    "group_extremes": whole("orders", "group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, best: (max_by(.o_totalprice) | .o_orderkey), least: (map(.o_totalprice) | min)})", "SELECT o_orderpriority AS p, arg_max(o_orderkey, o_totalprice) AS best, min(o_totalprice) AS least FROM orders GROUP BY 1"),
    "filter_group": whole("lineitem", '[.[] | select(.l_shipdate < "1995-06-01T00:00:00Z") | {flag: .l_returnflag, q: .l_quantity}] | group_by(.flag) | map({flag: .[0].flag, q: (map(.q) | add)})', "SELECT l_returnflag AS flag, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1"),
    "map_add": whole("part", "map(.p_size) | add", "SELECT sum(p_size)::BIGINT AS value FROM part"),
    "aggregate_object": whole("orders", "{n: length, most: (map(.o_totalprice) | max), open: (map(select(.o_orderstatus == \"O\")) | length), any: any(.o_totalprice > 400000)}", "SELECT count(*) AS n, max(o_totalprice) AS most, count(*) FILTER (o_orderstatus = 'O') AS open, bool_or(o_totalprice > 400000) AS any FROM orders"),
    "unique": whole("part", "map(.p_brand) | unique", "SELECT DISTINCT p_brand AS value FROM part"),
    "unique_by": whole("orders", "unique_by(.o_orderpriority) | map({o_orderpriority, o_orderkey})", "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", order=("o_orderkey",)),
    "min_by": whole("part", "min_by(.p_retailprice) | .p_retailprice", "SELECT min(p_retailprice) AS value FROM part"),
    "top_k": whole("orders", "sort_by(-.o_totalprice, .o_orderkey) | .[:10] | map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "top_k_per_group": whole("orders", "group_by(.o_custkey) | map(sort_by(.o_totalprice) | last) | map({o_custkey, o_totalprice})", "SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1"),
    "first_n_per_group": whole("lineitem", "group_by(.l_suppkey) | map(sort_by(-.l_extendedprice, .l_orderkey, .l_linenumber) | .[:2] | .[]) | map({l_suppkey, l_orderkey, l_extendedprice})", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2"),
    "last_sorted": whole("supplier", "sort_by(.s_acctbal) | last | .s_acctbal", "SELECT max(s_acctbal) AS value FROM supplier"),
    "running": whole("events", "[foreach .[] as $e (0; . + $e.user_id; {id: $e.event_id, sum: .})]", "SELECT event_id AS id, (sum(user_id) OVER (ORDER BY event_id))::BIGINT AS sum FROM events", order=("event_id",)),
    "reduce": whole("events", 'reduce .[] as $e (0; if $e.event_type == "click" then . + $e.user_id else . end)', "SELECT coalesce(sum(user_id) FILTER (event_type = 'click'), 0)::BIGINT AS value FROM events"),
    "union": whole("orders", ". + $orders | group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, n: length})", "SELECT o_orderstatus AS s, 2 * count(*) AS n FROM orders GROUP BY 1", tables=("orders",)),
    "difference": whole("nation", "[.[] | {k: .n_regionkey}] | . - $region", "SELECT n_regionkey AS k FROM nation WHERE n_regionkey > 2", tables=("region",), renamed={"region": "SELECT r_regionkey AS k FROM {region} WHERE r_regionkey <= 2"}),
    "equi_join": whole("orders", "[.[] as $o | $customer[] as $c | select($o.o_custkey == $c.c_custkey and $c.c_acctbal < 0) | {o: $o.o_orderkey, name: $c.c_name}]", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0", tables=("customer",)),
    "theta_join": whole("nation", ".[] as $n | $region[] as $r | select($n.n_regionkey < $r.r_regionkey) | {n: $n.n_name, r: $r.r_name}", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey < r_regionkey", tables=("region",)),
    "nulls_min": whole("labels", "map(.toxic) | min", "SELECT CASE WHEN count(*) = count(toxic) THEN min(toxic) END AS value FROM labels"),
    "nulls_unique": whole("labels", "map(.toxic) | unique | length", "SELECT (count(DISTINCT toxic) + max((toxic IS NULL)::INT))::BIGINT AS value FROM labels"),
    "nulls_group": whole("labels", "group_by(.toxic) | map({t: .[0].toxic, n: length, q: (map(.quality) | add), least: (map(.quality) | min), kinds: (map(.quality) | unique | length)})", "SELECT toxic AS t, count(*) AS n, sum(quality)::BIGINT AS q, CASE WHEN count(*) = count(quality) THEN min(quality) END AS least, (count(DISTINCT quality) + max((quality IS NULL)::INT))::BIGINT AS kinds FROM labels GROUP BY 1"),
    "nulls_group_count": whole("labels", "group_by(.toxic) | length", "SELECT count(*) AS value FROM (SELECT DISTINCT toxic FROM labels)"),
    "nulls_collect": whole("labels", "group_by(.quality) | map({q: .[0].quality, n: (map(.toxic) | length), ids: (map(select(.toxic == null)) | length)})", "SELECT quality AS q, count(*) AS n, count(*) FILTER (toxic IS NULL) AS ids FROM labels GROUP BY 1"),
    "join_index": whole("orders", "JOIN($customer | INDEX(.c_custkey); .o_custkey) | map({o: .[0].o_orderkey, name: .[1].c_name})", "SELECT o_orderkey AS o, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", tables=("customer",)),
    "join_group": whole("nation", "JOIN($region | INDEX(.r_regionkey); .n_regionkey) | map({region: .[1].r_name, n: .[0].n_nationkey}) | group_by(.region) | map({region: .[0].region, nations: length})", "SELECT r_name AS region, count(*) AS nations FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", tables=("region",)),
    "semi_join": whole("customer", "[.[] | select(.c_custkey | IN($orders[] | .o_custkey))] | map({c_custkey, c_name})", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", tables=("orders",)),
    "anti_join": whole("customer", "[.[] | select(IN(.c_custkey; $orders[] | .o_custkey) | not)] | map(.c_custkey)", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", tables=("orders",)),
    "top_words": whole("part", '[.[] | .p_name | splits(" ")] | map({w: .}) | group_by(.w) | map({w: .[0].w, n: length}) | sort_by(-.n, .w) | .[:20]', "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, w LIMIT 20"),
    "sorted_slice": whole("supplier", "sort_by(.s_suppkey) | .[5:10] | map(.s_name)", "SELECT s_name AS value FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 5"),
}

#: programs without relational form, over JSON texts; the interpreter runs them in Arrow batches
INTERPRETED = {
    "json_field": ("events", "{event_id, k: (.props | fromjson | .k)}", "SELECT json_object('event_id', event_id, 'k', (props->>'k')::BIGINT)::VARCHAR AS value FROM events"),
    "walk": ("events", 'walk(if type == "number" then . + 1 else . end) | {event_id, user_id}', "SELECT json_object('event_id', event_id + 1, 'user_id', user_id + 1)::VARCHAR AS value FROM events"),
    "paths": ("nation", "[paths | join(\".\")] | length", "SELECT '3' AS value FROM nation"),
    "tostream": ("region", "[tostream] | length", "SELECT '3' AS value FROM region"),
    "fromstream": ("region", "fromstream(tostream) | .r_name", "SELECT '\"' || r_name || '\"' AS value FROM region"),
    "label_break": ("region", "[label $out | range(10) | if . > 3 then break $out else . end] | add", "SELECT '6' AS value FROM region"),
    "recurse": ("region", "[recurse(if . < 3 then . + 1 else empty end; true)?] | length", None),
    "match": ("customer", '.c_name | match("0+") | .offset', "SELECT (instr(c_name, '0') - 1)::VARCHAR AS value FROM customer"),
    "try_catch": ("nation", "try error(.n_name) catch .", "SELECT '\"' || n_name || '\"' AS value FROM nation"),
    "to_entries": ("region", "to_entries | map(.key) | join(\",\")", "SELECT '\"r_regionkey,r_name\"' AS value FROM region"),
    "with_entries": ("region", "with_entries(select(.value | type == \"string\")) | .r_name", "SELECT '\"' || r_name || '\"' AS value FROM region"),
    "combinations": ("region", "[[range(.r_regionkey)], [1, 2]] | [combinations] | length", "SELECT (2 * r_regionkey)::VARCHAR AS value FROM region"),
    "getpath_setpath": ("region", "setpath([\"a\", \"b\"]; .r_regionkey) | getpath([\"a\", \"b\"])", "SELECT r_regionkey::VARCHAR AS value FROM region"),
    "limit_until": ("region", "[limit(3; 1 | repeat(.))] | add | until(. > 20; . * 2)", "SELECT '24' AS value FROM region"),
    "explode_implode": ("nation", ".n_name | explode | implode", "SELECT '\"' || n_name || '\"' AS value FROM nation"),
    "bessel": ("region", "0 | j0", "SELECT '1' AS value FROM region"),
}


#: further built-ins and forms, each over a table of some size
INTERPRETED |= {
    "paths": ("part", '[paths | join(".")] | .[2]', "SELECT '\"p_brand\"' AS value FROM part"),
    "leaf_paths": ("supplier", "{a: .s_suppkey, b: [.s_name, {c: .s_acctbal}]} | [leaf_paths | length] | add", "SELECT '6' AS value FROM supplier"),
    "tostream": ("customer", "{k: .c_custkey, s: [.c_mktsegment]} | [tostream] | .[1]", "SELECT '[[\"s\",0],\"' || c_mktsegment || '\"]' AS value FROM customer"),
    "truncate_stream": ("customer", "[1 | truncate_stream([[0], {a: 1}], [[1, 0], \"x\"], [[1, 0]], [[1]])] | length", "SELECT '2' AS value FROM customer"),
    "label_break": ("part", ".p_size as $n | [label $out | range(100) | if . > $n then break $out else . end] | length", "SELECT (p_size + 1)::VARCHAR AS value FROM part"),
    "recurse": ("part", "[.p_size | recurse(if . > 1 then . / 2 | floor else empty end)] | length", "SELECT (floor(log2(p_size)) + 1)::BIGINT::VARCHAR AS value FROM part"),
    "recurse_default": ("supplier", "[.s_nationkey, [.s_suppkey]] | [..] | length", "SELECT '4' AS value FROM supplier"),
    "limit_until": ("part", "[limit(3; .p_size | repeat(. * 2))] | add | until(. > 100; . * 2) | . > 100", "SELECT 'true' AS value FROM part"),
    "while_skip": ("part", "[.p_size | while(. < 100; . * 2)] | [skip(1; .[])] | first // 0", "SELECT CASE WHEN p_size * 2 < 100 THEN p_size * 2 ELSE 0 END::VARCHAR AS value FROM part"),
    "first_last": ("customer", "[first(.c_nationkey, 99), last(.c_nationkey, 99), nth(1; 5, .c_custkey, 7)]", "SELECT '[' || c_nationkey || ',99,' || c_custkey || ']' AS value FROM customer"),
    "has_in": ("customer", '[has("c_name"), has("x"), ("c_name" | in({c_name: 1})), ([.c_nationkey] | has(0)), ({a: .c_name} | inside({a: "Customer#000000000 and more", b: 1}))]', "SELECT '[true,false,true,true,' || contains('Customer#000000000 and more', c_name) || ']' AS value FROM customer"),
    "from_entries": ("customer", '[{key: .c_name, value: .c_custkey}, {name: "n", v: 1}] | from_entries | keys_unsorted | length', "SELECT '2' AS value FROM customer"),
    "entries_round_trip": ("part", "to_entries | from_entries | .p_brand", "SELECT '\"' || p_brand || '\"' AS value FROM part"),
    "map_values_del": ("part", "{a: .p_size, b: 2, c: null} | map_values(. + 1) | delpaths([[\"b\"]]) | del(.c) | .a", "SELECT (p_size + 1)::VARCHAR AS value FROM part"),
    "flatten_depth": ("part", "[.p_partkey, [.p_size, [[7]]]] | [flatten, flatten(1)] | map(length)", "SELECT '[3,3]' AS value FROM part"),
    "transpose": ("part", "[[.p_partkey, .p_size], [1]] | transpose | .[0] | add", "SELECT (p_partkey + 1)::VARCHAR AS value FROM part"),
    "bsearch": ("part", "[range(0; 100; 5)] as $a | .p_size as $x | $a | bsearch($x)", "SELECT CASE WHEN p_size % 5 = 0 THEN p_size // 5 ELSE -(p_size // 5) - 2 END::VARCHAR AS value FROM part"),
    "isempty": ("part", "[isempty(.p_size | select(. > 25)), any(.p_size, 3; . > 30), all(.p_size, 3; . < 40)]", "SELECT '[' || (p_size <= 25) || ',' || (p_size > 30) || ',' || (p_size < 40) || ']' AS value FROM part"),
    "reverse": ("customer", "[.c_name, .c_custkey] | reverse | .[0]", "SELECT c_custkey::VARCHAR AS value FROM customer"),
    "selectors": ("labels", "[.doc_id, .toxic, \"s\", [1], {}] | [(map(numbers) | length), (map(strings) | length), (map(nulls) | length), (map(iterables) | length), (map(scalars) | length), (map(values) | length)]", "SELECT CASE WHEN toxic IS NULL THEN '[1,1,1,2,3,4]' ELSE '[2,1,0,2,3,5]' END AS value FROM labels"),
    "trims": ("customer", '"  " + .c_mktsegment + " " | [(ltrim | length), (rtrim | length), (trim | trimstr("H") | length)]', "SELECT '[' || (len(c_mktsegment) + 1) || ',' || (len(c_mktsegment) + 2) || ',' || (len(c_mktsegment) - (CASE WHEN starts_with(c_mktsegment, 'H') THEN 1 ELSE 0 END)) || ']' AS value FROM customer"),
    "conversions": ("part", '[(.p_size | tostring | tonumber), (.p_size | tojson), ("true" | toboolean), (65 + (.p_size % 26) | [.] | implode | ascii_downcase | explode | .[0])]', "SELECT '[' || p_size || ',\"' || p_size || '\",true,' || (97 + p_size % 26) || ']' AS value FROM part"),
    "ascii": ("part", "65 + (.p_size % 26) | ascii", "SELECT '\"' || chr((65 + p_size % 26)::INT) || '\"' AS value FROM part"),
    "sub_flags": ("part", '[(.p_name | sub("(?<x>[aeiou])"; "<\\(.x)>")), (.p_brand | sub("B"; "b"; "i")), (.p_name | [splits("[ ]+")] | length)]', "SELECT '[\"' || regexp_replace(p_name, '([aeiou])', '<\\1>') || '\",\"' || regexp_replace(p_brand, 'B', 'b') || '\",' || len(string_split(p_name, ' ')) || ']' AS value FROM part"),
    "formats_more": ("part", '[(.p_size | @json), (.p_name | @text), (.p_name | @uri | @urid), ([.p_partkey, .p_name] | @tsv)] | .[0:3] + [(.[3] | split("\\t") | length)]', "SELECT '[\"' || p_size || '\",\"' || p_name || '\",\"' || p_name || '\",2]' AS value FROM part"),
    "date_parts": ("orders", '.o_orderkey * 3600 | [(gmtime | mktime), (todate | strptime("%Y-%m-%dT%H:%M:%SZ") | mktime), (localtime | .[0]), (strflocaltime("%Y") | tonumber)] | .[0:2]', "SELECT '[' || o_orderkey * 3600 || ',' || o_orderkey * 3600 || ']' AS value FROM orders"),
    "math_more": ("part", "[(.p_size | exp2 | log2), (.p_size | -. | abs), (.p_size / 4 | trunc), (.p_size | tan | atan | isnan), (.p_size | exp | log | round), (.p_size | exp10? // 1 | isinfinite), (.p_size | significand >= 1)]", "SELECT '[' || p_size || ',' || p_size || ',' || p_size // 4 || ',false,' || p_size || ',false,true]' AS value FROM part"),
    "math_two": ("part", "[fma(.p_size; 2; 1), (hypot(.p_size * 3; .p_size * 4) | round), (atan2(0; .p_size + 1)), (.p_size | scalb(.; 2)?) // 0] | .[0:3]", "SELECT '[' || (p_size * 2 + 1) || ',' || (p_size * 5) || ',0]' AS value FROM part"),
    "special_floats": ("part", "[(nan | isnan), (infinite | isinfinite), (.p_size | isnormal), (nan < .p_size)]", "SELECT '[true,true,true,true]' AS value FROM part"),
    "updates": ("part", ".p_size -= 1 | .p_size *= 2 | .none //= \"x\" | .p_partkey %= 7 | [.p_size, .none, .p_partkey]", "SELECT '[' || (p_size - 1) * 2 || ',\"x\",' || p_partkey % 7 || ']' AS value FROM part"),
    "update_generator": ("part", "[.p_size, [.p_partkey]] | (.. | numbers) |= . + 1 | [.[0], .[1][0]]", "SELECT '[' || (p_size + 1) || ',' || (p_partkey + 1) || ']' AS value FROM part"),
    "path_expressions": ("customer", "[path(.c_name), path(.a[0].b)] | [.[][0]]", """SELECT '["c_name","a"]' AS value FROM customer"""),
    "alternative_patterns": ("part", '(if .p_size % 2 == 0 then [.p_size] else {v: .p_size} end) as [$x] ?// {v: $x} | $x', "SELECT p_size::VARCHAR AS value FROM part"),
    "string_multiply_divide": ("part", '[("ab" * 2), ("a,b" / ","), ({a: {b: .p_size}} * {a: {c: 1}} | .a | length), ([.p_size, 1, 2] - [1])] | [.[0], .[2], (.[3] | length)]', "SELECT '[\"abab\",2,' || (CASE WHEN p_size = 1 THEN 1 ELSE 2 END) || ']' AS value FROM part"),
    "errors": ("part", '[(try error({n: .p_size}) catch .n), (.p_name.x? // "none"), ([.p_name | .[0]?] | length), (try (.p_size | keys) catch "no keys")]', "SELECT '[' || p_size || ',\"none\",0,\"no keys\"]' AS value FROM part"),
    "index_object": ("part", "INDEX([{id: .p_partkey}, {id: 5}][]; .id) | keys | length", "SELECT CASE WHEN p_partkey = 5 THEN 1 ELSE 2 END::VARCHAR AS value FROM part"),
    "environment": ("nation", '[($ENV | type), (env | type), ($__loc__ | .line), ([builtins] | length), (debug | has("n_name"))]', "SELECT '[\"object\",\"object\",1,1,true]' AS value FROM nation"),
    "limits_of_generators": ("part", "[limit(2; range(.p_size; 1000))] | add", "SELECT (2 * p_size + 1)::VARCHAR AS value FROM part"),
    "multiple_outputs": ("part", "{a: (.p_size, 1), b: 2} | .a", "SELECT unnest([p_size, 1])::VARCHAR AS value FROM part"),
}

#: programs over JSON texts made from events, by the native plan, and their SQL
TEXTS = {
    "text_field": (".actor.login", """SELECT '"u' || user_id || '"' AS value FROM events"""),
    "text_select": ('select(.type == "purchase")', """SELECT '{"id":' || event_id || ',"type":"' || event_type || '","actor":{"id":' || user_id || ',"login":"u' || user_id || '"},"cents":' || cents || ',"tags":["' || event_type || '","t"]}' AS value FROM e WHERE event_type = 'purchase'"""),
    "text_extract": ('select(.type == "purchase" and .cents > 1000) | .id', "SELECT event_id::VARCHAR AS value FROM e WHERE event_type = 'purchase' AND cents > 1000"),
    "text_or": ('select(.type == "error" or (.actor.id < 3)) | [.id, .type]', """SELECT '[' || event_id || ',"' || event_type || '"]' AS value FROM events WHERE event_type = 'error' OR user_id < 3"""),
    "text_predicate": ('select(.type | startswith("c")) | .actor.login', """SELECT '"u' || user_id || '"' AS value FROM events WHERE starts_with(event_type, 'c')"""),
    "text_object": ("{id, login: .actor.login, cents: .cents}", """SELECT '{"id":' || event_id || ',"login":"u' || user_id || '","cents":' || cents || '}' AS value FROM e"""),
    "text_length": (".type | length", "SELECT len(event_type)::VARCHAR AS value FROM events"),
    "text_keys": (".actor | keys", """SELECT '["id","login"]' AS value FROM events"""),
    "text_iterate": (".tags[] | ascii_upcase", """SELECT '"' || upper(unnest([event_type, 't'])) || '"' AS value FROM events"""),
    "text_map": (".tags | map(length)", "SELECT '[' || len(event_type) || ',1]' AS value FROM events"),
}
CENTS = "WITH e AS (SELECT *, round(value * 100)::BIGINT AS cents FROM events) "


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, place, doc): events as JSON lines."""
    actor = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("login"))
    doc = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), actor.alias("actor"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.array("event_type", F.lit("t")).alias("tags"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("").alias("file"), F.monotonically_increasing_id().alias("place"), F.to_json(doc).alias("doc"))


def over_texts(program: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_documents(event_texts(spark, sf_dir), program, plan="native").where("error is null").select("value")


def interpreted(table: str, program: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rows_as_json(spark.read.parquet(f"{sf_dir}/{table}.parquet"), deal=True)
        return interpret(docs, program).where(F.col("error").isNull()).select("value")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **{name: interpreted(table, program) for name, (table, program, _) in INTERPRETED.items()}, **{name: over_texts(program) for name, (program, _) in TEXTS.items()}}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql} | {name: sql for name, (_, _, sql) in INTERPRETED.items() if sql} | {name: CENTS + sql for name, (_, sql) in TEXTS.items()}
