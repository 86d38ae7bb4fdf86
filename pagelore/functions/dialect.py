"""One definition of a rule, spelled for Spark SQL and for the DuckDB oracle.

Rules are written once as SQL text over a :class:`Dialect`; the Spark spelling runs in
Catalyst with only built-in functions, the DuckDB spelling is its oracle. Patterns avoid
the classes on which the regex engines differ: white space is spelled out (:data:`WS`),
``\\w`` is ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

# Fixed value: the code points that count as white space.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


class Dialect:
    """Spellings that both engines share; subclasses have the rest."""

    name = ""

    def lit(self, s: str | None) -> str:
        raise NotImplementedError

    def value(self, v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else self.lit(str(v))

    def rows(self, name: str, columns: str, rows: Sequence[Sequence[object]]) -> str:
        """An inline table; ``columns``: "a BIGINT, b STRING"."""
        cols = [c.strip().split(" ") for c in columns.split(",")]
        body = ", ".join("(" + ", ".join(self.value(v) for v in r) + ")" for r in rows)
        raw = ", ".join(f"c{i}" for i in range(len(cols)))
        picks = ", ".join(f"CAST(c{i} AS {kind}) AS {c}" for i, (c, kind) in enumerate(cols))
        return f"(SELECT {picks} FROM (VALUES {body}) AS v({raw})) AS {name}"

    def full(self, x: str, pattern: str) -> str:
        return self.match(x, rf"\A(?:{pattern})\z")

    def match(self, x: str, pattern: str) -> str:
        raise NotImplementedError

    def replace(self, x: str, pattern: str, by: str) -> str:
        raise NotImplementedError

    def ws_norm(self, x: str) -> str:
        return f"trim({self.replace(x, f'[{WS}]+', ' ')})"

    def strip(self, x: str) -> str:
        return self.replace(x, rf"\A[{WS}]+|[{WS}]+\z", "")

    def any_of(self, x: str, terms: Sequence[str]) -> str:
        return "(" + " OR ".join(f"contains({x}, {self.lit(t)})" for t in terms) + ")"

    def in_(self, x: str, terms: Sequence[str]) -> str:
        return f"{x} IN (" + ", ".join(self.lit(t) for t in terms) + ")"

    def id4(self, prefix: str, n: str) -> str:
        """``n`` with four digits at least, behind a prefix."""
        s = f"CAST({n} AS STRING)"
        return f"concat({self.lit(prefix)}, lpad({s}, CAST(greatest(4, length({s})) AS INT), '0'))"


class Spark(Dialect):
    name = "spark"

    def lit(self, s: str | None) -> str:
        if s is None:
            return "NULL"
        s = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        return "'" + s.replace("{", "{{").replace("}", "}}") + "'"  # spark.sql(..., name=df) formats the text

    def t(self, name: str) -> str:
        return "{" + name + "}"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[\\](\d)', r'$\1', by))})"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)"

    def explode(self, source: str, array: str, pos: str, item: str) -> str:
        return f"(SELECT t.*, CAST(v.p + 1 AS BIGINT) AS {pos}, v.i AS {item} FROM (SELECT * FROM {source}) t LATERAL VIEW posexplode({array}) v AS p, i)"

    def seq(self, source: str, lo: str, hi: str, item: str) -> str:
        """Rows of ``source`` with every integer of lo..hi (none if hi < lo)."""
        return f"(SELECT t.*, CAST(v.i AS BIGINT) AS {item} FROM (SELECT * FROM {source}) t LATERAL VIEW explode(CASE WHEN {hi} >= {lo} THEN sequence({lo}, {hi}) ELSE CAST(array() AS ARRAY<BIGINT>) END) v AS i)"

    def keep(self, array: str, x: str, cond: str) -> str:
        return f"filter({array}, {x} -> {cond})"

    def map(self, array: str, x: str, e: str) -> str:
        return f"transform({array}, {x} -> {e})"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})"

    def sorted(self, array: str) -> str:
        return f"array_sort({array})"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep))})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def starts(self, x: str, prefix: str) -> str:
        return f"startswith({x}, {self.lit(prefix)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def code(self, x: str) -> str:
        return f"CAST(ascii({x}) AS BIGINT)"

    def chars(self, x: str) -> str:
        return f"split({x}, '')"

    def recursive(self) -> str:
        return "RECURSIVE"

    def first_value(self, x: str) -> str:
        return f"first_value({x}) IGNORE NULLS"

    def last_value(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def append(self, array: str, x: str) -> str:
        return f"array_append({array}, {x})"

    def struct(self, *items: str) -> str:
        return f"struct({', '.join(items)})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, {self.lit('$.' + key)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def fold_i(self, x: str) -> str:
        return "(?iu)" + x

    def bounded(self, x: str) -> str:
        return x


class Duck(Dialect):
    name = "duck"

    def lit(self, s: str | None) -> str:
        return "NULL" if s is None else "'" + s.replace("'", "''") + "'"

    def t(self, name: str) -> str:
        return name

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def explode(self, source: str, array: str, pos: str, item: str) -> str:
        return f"(SELECT t.*, CAST(generate_subscripts({array}, 1) AS BIGINT) AS {pos}, unnest({array}) AS {item} FROM (SELECT * FROM {source}) t)"

    def seq(self, source: str, lo: str, hi: str, item: str) -> str:
        return f"(SELECT t.*, unnest(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1)) AS {item} FROM (SELECT * FROM {source}) t)"

    def keep(self, array: str, x: str, cond: str) -> str:
        return f"list_filter({array}, lambda {x}: {cond})"

    def map(self, array: str, x: str, e: str) -> str:
        return f"list_transform({array}, lambda {x}: {e})"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def join(self, array: str, sep: str) -> str:
        return f"coalesce(array_to_string({array}, {self.lit(sep)}), '')"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {order})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})" if sep != "\n" else f"string_split({x}, chr(10))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, {self.lit(prefix)})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def code(self, x: str) -> str:
        return f"CAST(unicode({x}) AS BIGINT)"

    def chars(self, x: str) -> str:
        return f"string_split({x}, '')"

    def recursive(self) -> str:
        return "RECURSIVE"

    def first_value(self, x: str) -> str:
        return f"first_value({x} IGNORE NULLS)"

    def last_value(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def has(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"

    def append(self, array: str, x: str) -> str:
        return f"list_append({array}, {x})"

    def struct(self, *items: str) -> str:
        return f"row({', '.join(items)})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, {self.lit('$.' + key)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def fold_i(self, x: str) -> str:
        return "(?i)" + x

    def bounded(self, x: str) -> str:
        """This engine's word borders are ASCII; other letters become an ASCII word character."""
        return self.replace(x, r"[\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{370}-\x{1fff}\x{2c00}-\x{2fef}\x{3040}-\x{d7ff}]", "_")


SPARK, DUCK = Spark(), Duck()
