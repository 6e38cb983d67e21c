"""A read-only Cypher subset, planned as DataFrame joins.

Supported: MATCH with comma-separated patterns; node labels and property maps; relationship types, properties, either or
no direction, and lengths ``*a..b``; WHERE with AND, OR, NOT, comparisons, IN, CONTAINS, STARTS WITH, ENDS WITH and
NOT EXISTS { MATCH ... }; RETURN [DISTINCT] with aliases, labels, count, collect (as a sorted array), sum, avg, min and max, of
DISTINCT values too; ORDER BY; SKIP; LIMIT. There is no
production for a clause that writes, so a query that is accepted cannot write.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|<=|>=|\.\.|->|<-|[-\[\](){}:,.=<>*|]))""")
_WORDS = {"MATCH", "WHERE", "RETURN", "DISTINCT", "AS", "ORDER", "BY", "SKIP", "LIMIT", "AND", "OR", "NOT", "IN", "CONTAINS", "STARTS", "ENDS", "WITH", "EXISTS", "DESC", "ASC", "TRUE", "FALSE", "NULL"}


AGGREGATES = ("count", "collect", "sum", "avg", "min", "max")


class CypherError(ValueError):
    """The query is outside the subset."""


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class Rel:
    var: str | None
    types: list[str]
    props: dict[str, Any]
    way: str  # out, in or both
    least: int = 1
    most: int = 1


class _Key(str):
    """A keyword in upper case that remembers how it was written, as names may read like keywords."""

    raw: str


def _key(text: str) -> _Key:
    out = _Key(text.upper())
    out.raw = text
    return out


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            if not text[at:].strip():
                break
            raise CypherError(f"cannot read {text[at:at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append(("key", _key(value)) if kind == "word" and value.upper() in _WORDS else (kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.n = _tokens(text), 0, 0

    def peek(self, value: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] in ("key", "op") and self.t[self.i][1] == value

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CypherError(f"expected {value} at {self.t[self.i:self.i + 3]}")

    def word(self) -> str:
        if self.i < len(self.t) and self.t[self.i][0] in ("word", "key"):
            self.i += 1
            name = self.t[self.i - 1][1]
            return getattr(name, "raw", name)
        raise CypherError(f"expected a name at {self.t[self.i:self.i + 3]}")

    def fresh(self) -> str:
        self.n += 1
        return f"_{self.n}"

    def literal(self) -> Any:
        if self.i >= len(self.t):
            raise CypherError("expected a value at the end")
        kind, value = self.t[self.i]
        self.i += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            return float(value) if "." in value else int(value)
        if kind == "op" and value == "-":
            return -self.literal()
        if kind == "key" and value in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[value]
        raise CypherError(f"expected a value, found {value}")

    def props(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.take("{"):
            while not self.take("}"):
                name = self.word()
                self.need(":")
                out[name] = self.literal()
                self.take(",")
        return out

    def node(self) -> Node:
        self.need("(")
        var = self.word() if self.t[self.i][0] == "word" else self.fresh()
        label = self.word() if self.take(":") else None
        props = self.props()
        self.need(")")
        return Node(var, label, props)

    def rel(self) -> Rel:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, props, least, most = None, [], {}, 1, 1
        if self.take("["):
            if self.t[self.i][0] == "word":
                var = self.word()
            if self.take(":"):
                types.append(self.word())
                while self.take("|"):
                    self.take(":")
                    types.append(self.word())
            if self.take("*"):
                least = self.literal()
                self.need("..")
                most = self.literal()
            props = self.props()
            self.need("]")
        if back:
            self.need("-")
            return Rel(var, types, props, "in", least, most)
        way = "out" if self.take("->") else "both"
        if way == "both":
            self.need("-")
        return Rel(var, types, props, way, least, most)

    def patterns(self) -> list[list[Node | Rel]]:
        out = []
        while True:
            chain: list[Node | Rel] = [self.node()]
            while self.peek("-") or self.peek("<-"):
                chain += [self.rel(), self.node()]
            out.append(chain)
            if not self.take(","):
                return out

    def condition(self) -> tuple:
        left = self.conjunction()
        while self.take("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        if self.take("NOT"):
            if self.take("EXISTS"):
                self.need("{")
                self.need("MATCH")
                patterns = self.patterns()
                where = self.condition() if self.take("WHERE") else None
                self.need("}")
                return ("absent", patterns, where)
            return ("not", self.negation())
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        left = self.value()
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.literal())
                self.take(",")
            return ("in", left, values)
        for key in ("CONTAINS", "STARTS", "ENDS"):
            if self.take(key):
                if key != "CONTAINS":
                    self.need("WITH")
                return (key.lower(), left, self.value())
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return (op, left, self.value())
        return ("is", left)

    def value(self) -> tuple:
        if self.t[self.i][0] == "word":
            name = self.word()
            if self.take("("):
                if name.lower() not in (*AGGREGATES, "labels"):
                    raise CypherError(f"no function {name}")
                distinct = self.take("DISTINCT")
                inner = ("all",) if self.take("*") else self.value()
                self.need(")")
                return (name.lower(), inner, distinct)
            return ("prop", name, self.word()) if self.take(".") else ("var", name)
        return ("lit", self.literal())

    def query(self) -> dict[str, Any]:
        self.need("MATCH")
        patterns = self.patterns()
        while self.take("MATCH"):
            patterns += self.patterns()
        where = self.condition() if self.take("WHERE") else None
        self.need("RETURN")
        distinct, items = self.take("DISTINCT"), []
        while True:
            at = self.i
            value = self.value()
            text = "".join(v for _, v in self.t[at : self.i])
            items.append((value, self.word() if self.take("AS") else text))
            if not self.take(","):
                break
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                at = self.i
                value = self.value()
                order.append((value, "".join(v for _, v in self.t[at : self.i]), self.take("DESC") or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        skip = self.literal() if self.take("SKIP") else None
        limit = self.literal() if self.take("LIMIT") else None
        if self.i < len(self.t):
            raise CypherError(f"cannot read on at {self.t[self.i:self.i + 3]}")
        return {"patterns": patterns, "where": where, "distinct": distinct, "items": items, "order": order, "skip": skip, "limit": limit}


def parse(text: str) -> dict[str, Any]:
    """The query's clauses; :class:`CypherError` for anything outside the subset, clauses that write included."""
    return _Parser(text).query()


def _vars(of: Any) -> set[str]:
    """The variables in a condition or value."""
    if isinstance(of, tuple) and of and of[0] in ("prop", "var"):
        return {of[1]}
    return set().union(*map(_vars, of)) if isinstance(of, tuple) else set()


class Graph:
    """``nodes`` (``id``, ``label``, properties) and ``edges`` (``src``, ``dst``, ``type``, properties) as a Cypher target."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    def _scan(self, n: Node) -> DataFrame:
        df = self.nodes if n.label is None else self.nodes.where(F.col("label") == n.label)
        for k, v in n.props.items():
            df = df.where(F.col(k) == v)
        return df.select(*[F.col(c).alias(f"{n.var}__{c}") for c in df.columns])

    def _steps(self, r: Rel) -> DataFrame:
        df = self.edges if not r.types else self.edges.where(F.col("type").isin(r.types))
        for k, v in r.props.items():
            df = df.where(F.col(k) == v)
        rest = [c for c in df.columns if c not in ("src", "dst")]
        out = df.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), *rest)
        back = df.select(F.col("dst").alias("__a"), F.col("src").alias("__b"), *rest)
        df = out if r.way == "out" else back if r.way == "in" else out.union(back)
        if (r.least, r.most) == (1, 1):
            name = r.var
            return df.select("__a", "__b", *([F.col(c).alias(f"{name}__{c}") for c in rest] if name else []))
        hop, total = df.select("__a", "__b"), None
        reach = hop
        for k in range(1, r.most + 1):
            if k >= r.least:
                total = reach if total is None else total.union(reach)
            if k < r.most:
                reach = reach.join(hop.select(F.col("__a").alias("__m"), F.col("__b").alias("__c")), F.col("__b") == F.col("__m")).select("__a", F.col("__c").alias("__b"))
        return total

    def _match(self, patterns: list[list[Node | Rel]], bound: DataFrame | None = None, known: set[str] | None = None) -> tuple[DataFrame, set[str]]:
        df, seen = bound, set(known or ())
        for chain in patterns:
            first = chain[0]
            df = self._add(df, seen, first)
            at = first
            for r, n in zip(chain[1::2], chain[2::2]):
                df = df.join(self._steps(r), F.col(f"{at.var}__id") == F.col("__a")).drop("__a")
                if n.var in seen:
                    df = df.where(F.col("__b") == F.col(f"{n.var}__id")).drop("__b")
                    df = self._filter(df, n)
                else:
                    df = df.join(self._scan(n), F.col("__b") == F.col(f"{n.var}__id")).drop("__b")
                    seen.add(n.var)
                at = n
        return df, seen

    def _add(self, df: DataFrame | None, seen: set[str], n: Node) -> DataFrame:
        if n.var in seen:
            return self._filter(df, n)
        seen.add(n.var)
        scan = self._scan(n)
        if df is None:
            return scan
        raise CypherError(f"pattern of {n.var} shares no variable with those before it")

    def _filter(self, df: DataFrame, n: Node) -> DataFrame:
        if n.label is not None:
            df = df.where(F.col(f"{n.var}__label") == n.label)
        for k, v in n.props.items():
            df = df.where(F.col(f"{n.var}__{k}") == v)
        return df

    def _value(self, v: tuple) -> Column:
        kind = v[0]
        if kind == "prop":
            return F.col(f"{v[1]}__{v[2]}")
        if kind == "var":
            return F.col(f"{v[1]}__id")
        if kind == "labels":
            return F.col(f"{v[1][1]}__label")
        if kind in AGGREGATES:
            return F.count("*") if (kind, v[1]) == ("count", ("all",)) else self._aggregate(v, self._value(v[1]))
        return F.lit(v[1])

    def _aggregate(self, v: tuple, inner: Column) -> Column:
        kind = v[0]
        if kind == "collect":  # as a sorted array, so that reruns agree
            return F.array_sort(F.collect_set(inner) if v[2] else F.collect_list(inner))
        if v[2] and kind in ("sum", "avg"):
            return F.sum_distinct(inner) / (F.count_distinct(inner) if kind == "avg" else F.lit(1))
        if kind == "count":
            return F.count_distinct(inner) if v[2] else F.count(inner)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](inner)

    def _test(self, c: tuple) -> Column:
        kind = c[0]
        if kind in ("and", "or"):
            a, b = self._test(c[1]), self._test(c[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self._test(c[1])
        if kind == "is":
            return self._value(c[1])
        left = self._value(c[1])
        if kind == "in":
            return left.isin(c[2])
        right = self._value(c[2])
        return {
            "=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right,
            ">=": lambda: left >= right, "contains": lambda: left.contains(right), "starts": lambda: left.startswith(right), "ends": lambda: left.endswith(right),
        }[kind]()

    def query(self, text: str) -> DataFrame:
        """The rows of ``text``. Single-variable conditions reach the scans through the optimizer."""
        q = parse(text)
        conditions, todo = [], [q["where"]] if q["where"] else []
        while todo:
            c = todo.pop()
            if c[0] == "and":
                todo += [c[1], c[2]]
            else:
                conditions.append(c)
        groups = [(v, a) for v, a in q["items"] if v[0] not in AGGREGATES]
        counts = [(v, a) for v, a in q["items"] if v[0] in AGGREGATES]
        apart = self._apart(q["patterns"], conditions, groups, counts)
        if apart is None:
            df = self._where(*self._match(q["patterns"]), conditions)
        if counts:
            if apart is None:
                df = df.groupBy(*[self._value(v).alias(a) for v, a in groups]).agg(*[self._value(v).alias(a) for v, a in counts])
            else:
                df = apart
            df = df.select(*[F.col(f"`{a}`") for _, a in q["items"]])
            order = [(F.col(f"`{n}`"), d) for _, n, d in q["order"]]
        else:
            sorts = [(a, F.col(f"`{a}`") if v[0] == "var" and a in {x for _, x in q["items"]} else self._value(v), d) for v, a, d in q["order"]]
            names = {a: v for v, a in q["items"]}
            extra = [(f"__o{k}", self._value(names[a]) if a in names else e) for k, (a, e, _) in enumerate(sorts)]
            df = df.select(*[self._value(v).alias(a) for v, a in q["items"]], *([] if q["distinct"] else [e.alias(n) for n, e in extra]))
            if q["distinct"]:
                df = df.distinct()
                order = [(F.col(f"`{a}`"), d) for a, _, d in sorts]
            else:
                order = [(F.col(n), d) for (n, _), (_, _, d) in zip(extra, sorts)]
        if order:
            df = df.orderBy(*[c.desc() if d else c.asc() for c, d in order])
        if q["skip"]:
            df = df.offset(q["skip"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return df.select(*[F.col(f"`{a}`") for _, a in q["items"]])

    def _where(self, df: DataFrame, seen: set[str], conditions: list[tuple]) -> DataFrame:
        for c in conditions:
            df = self._absent(df, seen, c[1], c[2]) if c[0] == "absent" else df.where(self._test(c))
        return df

    def _apart(self, patterns: list, conditions: list[tuple], groups: list, counts: list) -> DataFrame | None:
        """The aggregates, each from the patterns that it needs; None where that saves nothing.

        Aggregates of distinct values do not see how often a row is matched. So a pattern that meets the others in one variable, and of which an aggregate
        needs no other, only says which values of that variable have a match, and its rows are not multiplied with those of the others.
        """
        if len(patterns) < 2 or not counts or any(v[1] == ("all",) or not (v[2] or v[0] in ("min", "max")) for v, _ in counts):
            return None
        names = [{x.var for x in chain if x.var} for chain in patterns]
        whole = [c for c in conditions if c[0] == "absent" or not any(_vars(c) <= n for n in names)]
        if any(c[0] == "absent" for c in whole):
            return None
        always = set().union(*[_vars(v) for v, _ in groups], *[_vars(c) for c in whole])
        firsts = [chain[0].var for chain in patterns]
        left = [self._needed(firsts, names, always | _vars(v)) for v, _ in counts]
        if not self._linked(firsts, names, list(range(len(names)))) or not any(ears for _, ears in left):
            return None
        # A variable's label and properties may be told in a pattern that is matched elsewhere: every pattern gets them.
        told: dict[str, Node] = {}
        for n in (x for chain in patterns for x in chain if isinstance(x, Node)):
            at = told.setdefault(n.var, Node(n.var))
            if (at.label and n.label and at.label != n.label) or any(at.props.get(k, v) != v for k, v in n.props.items()):
                return None
            at.label, at.props = at.label or n.label, at.props | n.props
        patterns = [[told[x.var] if isinstance(x, Node) else x for x in chain] for chain in patterns]

        def rows(kept: list[int], ears: list[tuple[int, str]]) -> DataFrame:
            df, seen = self._match([patterns[k] for k in kept])
            bound = set().union(*[names[k] for k in kept])
            df = self._where(df, seen, [c for c in conditions if _vars(c) <= bound])
            for n, (k, var) in enumerate(ears):
                if var in bound:
                    keys = rows([k], ears[:n]).select(F.col(f"{var}__id").alias("__x")).distinct()
                    df = df.join(keys, F.col(f"{var}__id") == F.col("__x"), "left_semi")
            return df

        parts = []
        for (v, _), (kept, ears) in zip(counts, left):
            parts.append(rows(kept, ears).select(*[self._value(g).alias(f"__g{k}") for k, (g, _) in enumerate(groups)], self._value(v[1]).alias("__v")))
        out, on = None, [f"__g{k}" for k in range(len(groups))]
        for n, ((v, a), part) in enumerate(zip(counts, parts)):
            each = part.groupBy(*on).agg(self._aggregate(v, F.col("__v")).alias(f"__r{n}"))
            if out is None:
                out = each
            else:
                # Groups are the same in all parts; a null is a group too.
                other = each.select(*[F.col(g).alias(f"{g}r") for g in on], f"__r{n}")
                out = out.join(other, reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{g}r")) for g in on], F.lit(True))).drop(*[f"{g}r" for g in on])
        return out.select(*[F.col(g).alias(a) for g, (_, a) in zip(on, groups)], *[F.col(f"__r{n}").alias(a) for n, (_, a) in enumerate(counts)])

    def _needed(self, firsts: list[str], names: list[set[str]], needed: set[str]) -> tuple[list[int], list[tuple[int, str]]]:
        """The patterns (by place) that hold what is needed, and the others in the order in which they fall off, each with the one variable that it shares."""
        kept, ears = list(range(len(names))), []
        while True:
            for k in reversed(kept):
                others = [j for j in kept if j != k]
                elsewhere = set().union(*[names[j] for j in others])
                tied = names[k] & (needed | elsewhere)
                if len(tied) == 1 and tied <= elsewhere and self._linked(firsts, names, others):
                    ears.append((k, tied.pop()))
                    kept = others
                    break
            else:
                return kept, ears

    @staticmethod
    def _linked(firsts: list[str], names: list[set[str]], kept: list[int]) -> bool:
        """Whether each pattern begins with a variable of those before it, as :meth:`_match` needs."""
        return all(firsts[k] in set().union(*[names[j] for j in kept[:n]]) for n, k in enumerate(kept) if n)

    def _absent(self, df: DataFrame, seen: set[str], patterns: list, where: tuple | None) -> DataFrame:
        """Rows for which the inner pattern has no match: an anti-join on the variables that it shares."""
        inner, names = self._match(patterns)
        shared = sorted(names & seen)
        if not shared:
            raise CypherError("NOT EXISTS shares no variable with the outer pattern")
        if where is not None:
            inner = inner.where(self._test(where))
        keys = inner.select(*[F.col(f"{v}__id").alias(f"__x_{v}") for v in shared]).distinct()
        on = reduce(lambda a, b: a & b, [F.col(f"{v}__id") == F.col(f"__x_{v}") for v in shared])
        return df.join(keys, on, "left_anti")
