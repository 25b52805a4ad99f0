"""What Spark SQL and DuckDB write differently.

Operators are SQL texts built with a dialect: :data:`SPARK` to run, :data:`DUCK`
for the text that the oracle runs over the same tables.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def round(self, x: str, digits: int) -> str:
        return f"round({x}, {digits})"

    def epoch(self, ts: str) -> str:
        """Whole seconds since 1970, no time zone applied (sessions run in UTC)."""
        return f"unix_seconds(cast({ts} as timestamp))"

    def from_epoch(self, x: str) -> str:
        return f"cast(timestamp_seconds({x}) as timestamp_ntz)"

    def dow(self, ts: str) -> str:
        """Day of week, Sunday is 0."""
        return f"cast(dayofweek({ts}) - 1 as bigint)"

    def join_distinct(self, x: str, sep: str = ", ") -> str:
        return f"array_join(sort_array(collect_set({x})), '{sep}')"

    def pattern(self, p: str) -> str:
        # braces name tables in plans, so a pattern's own are doubled
        return "r'" + p.replace("{", "{{").replace("}", "}}") + "'"

    def matches(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def replace_all(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')"

    def explode(self, x: str) -> str:
        return f"explode({x})"

    def ends(self, *columns: str) -> str:
        """Both accounts of every transfer, with columns of it; one pass over the ledger."""
        return f"select explode(array(from_account, to_account)) as account_id{''.join(f', {c}' for c in columns)} from {{tx}}"

    def try_timestamp(self, x: str, spark_format: str, duck_format: str) -> str:
        return f"cast(try_to_timestamp({x}, \"{spark_format}\") as timestamp_ntz)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def keep_if(self, array: str, var: str, cond: str) -> str:
        return f"filter({array}, {var} -> {cond})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def first_n(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def sorted_list(self, x: str) -> str:
        return f"sort_array(collect_list({x}))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def fixed(self, x: str, digits: int) -> str:
        """A number with fixed decimals, from a decimal value."""
        return f"cast(cast({x} as decimal(38, {digits})) as string)"

    def hash_order(self, x: str) -> str:
        return f"md5(cast(cast({x} as string) as binary))"

    def host(self, url: str) -> str:
        return f"lower(regexp_extract({url}, {self.pattern('^[a-z]+://([^/:]+)')}, 1))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def quote(self, name: str) -> str:
        return f"`{name}`"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)}, -1)"

    def indexed(self, array: str, body: str) -> str:
        """``body`` of ``x``, an element of ``array``, and ``i``, its place from 1."""
        return f"transform({array}, (x, i0) -> {body.replace('$i', '(i0 + 1)')})"

    def last(self, value: str, by: str) -> str:
        return f"max_by({value}, {by})"

    def find(self, x: str, part: str) -> str:
        return f"instr({x}, {part})"

    def cardinality_map(self, keys: list[str], values: list[str], x: str) -> str:
        whens = " ".join(f"when {k} then {v}" for k, v in zip(keys, values, strict=True))
        return f"case {x} {whens} end"


class Duck(Spark):
    name = "duck"

    def round(self, x: str, digits: int) -> str:
        # through the shortest decimal text, as Spark rounds a double
        return f"cast(round(cast(cast({x} as varchar) as decimal(38, 18)), {digits}) as double)"

    def epoch(self, ts: str) -> str:
        return f"cast(floor(epoch({ts})) as bigint)"

    def from_epoch(self, x: str) -> str:
        return f"cast(make_timestamp(cast({x} as bigint) * 1000000) as timestamp)"

    def dow(self, ts: str) -> str:
        return f"cast(dayofweek({ts}) as bigint)"

    def join_distinct(self, x: str, sep: str = ", ") -> str:
        return f"coalesce(string_agg(distinct {x}, '{sep}' order by {x}), '')"

    def pattern(self, p: str) -> str:
        return "'" + p + "'"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def extract_all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)})"

    def replace_all(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}', 'g')"

    def explode(self, x: str) -> str:
        return f"unnest({x})"

    def ends(self, *columns: str) -> str:
        of = "".join(f", {c}" for c in columns)
        return f"select from_account as account_id{of} from {{tx}} union all select to_account{of} from {{tx}}"

    def try_timestamp(self, x: str, spark_format: str, duck_format: str) -> str:
        return f"try_strptime({x}, '{duck_format}')"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def keep_if(self, array: str, var: str, cond: str) -> str:
        return f"list_filter({array}, lambda {var}: {cond})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def first_n(self, array: str, n: int) -> str:
        return f"{array}[1:{n}]"

    def sorted_list(self, x: str) -> str:
        return f"list({x} order by {x})"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def fixed(self, x: str, digits: int) -> str:
        return f"cast(cast({x} as decimal(38, {digits})) as varchar)"

    def hash_order(self, x: str) -> str:
        return f"md5(cast({x} as varchar))"

    def host(self, url: str) -> str:
        return f"lower(regexp_extract({url}, '^[a-z]+://([^/:]+)', 1))"

    def size(self, array: str) -> str:
        return f"len({array})"

    def quote(self, name: str) -> str:
        return f'"{name}"'

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.pattern(p)})"

    def indexed(self, array: str, body: str) -> str:
        return f"list_transform({array}, lambda x, i0: {body.replace('$i', 'i0')})"

    def last(self, value: str, by: str) -> str:
        return f"arg_max({value}, {by})"

    def find(self, x: str, part: str) -> str:
        return f"strpos({x}, {part})"


SPARK, DUCK = Spark(), Duck()
