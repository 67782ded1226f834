"""The strict SQL subset: one entity per statement. What isn't listed here fails to parse."""

from __future__ import annotations

import re
from decimal import Decimal
from typing import Any

from quillon.functions.errors import refuse
from quillon.plans import nodes as N

MAX_TEXT, MAX_TOKENS, MAX_DEPTH, MAX_BLOB = (2 << 20) + 4096, 32_768, 128, 1 << 20
TOKEN = re.compile(r"\s*(?:(?P<blob>[xX]'(?P<hex>[^']*)')|(?P<str>'(?:[^']|'')*')|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><>|<=|>=|!=|[=<>+\-*/(),.;]))")
#: Words that end an expression or can't name a field.
RESERVED = set("SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AS AND OR NOT IN IS NULL TRUE FALSE BETWEEN LIKE ILIKE CASE WHEN THEN ELSE END ASC DESC INSERT INTO VALUES UPDATE SET DELETE RETURNING DEFAULT JOIN UNION INTERSECT EXCEPT WITH OVER CAST ON USING WINDOW".split())
FUNCTIONS = set("ABS CBRT CEIL CEILING COALESCE CONTAINS ENDS_WITH EXP FLOOR LEFT LENGTH LN LOG LOG2 LOG10 LOWER LTRIM MOD NULLIF OCTET_LENGTH POSITION POWER POW REPLACE RIGHT ROUND RTRIM SIGN SQRT STARTS_WITH SUBSTRING TRIM TRUNC TRUNCATE UPPER".split())
UNSUPPORTED = {"JOIN", "UNION", "INTERSECT", "EXCEPT", "WITH", "OVER", "CAST", "BEGIN", "COMMIT", "ROLLBACK", "WINDOW", "INNER", "CROSS"}


def tokenize(text: str) -> list[tuple[str, Any]]:
    if len(text.encode()) > MAX_TEXT:
        refuse("sql_too_long", f"a statement has at most {MAX_TEXT} bytes")
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            what = text[at:].strip()[:1]
            refuse("quoted_identifier" if what in '"`' else "parameter" if what == "?" else "syntax", f"unexpected {what!r}")
        at = m.end()
        if m["blob"]:
            if not re.fullmatch(r"(?:[0-9a-fA-F]{2})*", m["hex"]) or len(m["hex"]) > 2 * MAX_BLOB:
                refuse("syntax", "a blob literal has an even number of hex digits and at most 1 MiB")
            out.append(("blob", bytes.fromhex(m["hex"])))
        elif m["str"]:
            out.append(("text", m["str"][1:-1].replace("''", "'")))
        elif m["num"]:
            out.append(("num", Decimal(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["name"]:
            out.append(("name", m["name"]))
        else:
            out.append(("op", {"<>": "!="}.get(m["op"], m["op"])))
        if len(out) > MAX_TOKENS:
            refuse("sql_too_long", f"a statement has at most {MAX_TOKENS} tokens")
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.depth, self.alias = tokenize(text), 0, 0, None
        if self.tokens and self.tokens[-1] == ("op", ";"):
            self.tokens.pop()

    # tokens
    def peek(self, k: int = 0) -> tuple[str, Any]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def word(self, k: int = 0) -> str:
        kind, v = self.peek(k)
        return v.upper() if kind == "name" else v if kind == "op" else ""

    def take(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, why: str):
        w = self.word()
        refuse("unsupported" if w in UNSUPPORTED else "syntax", f"{why}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, v = self.peek()
        if kind != "name" or v.upper() in RESERVED:
            self.fail("expected a name")
        self.at += 1
        return v

    def number(self) -> int:
        kind, v = self.peek()
        if kind != "num" or not isinstance(v, int) or v >= 1 << 32:
            self.fail("expected a whole number")
        self.at += 1
        return v

    def commas(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def entity(self) -> str:
        n = self.name()
        while self.take("."):
            n = self.name()
        return n

    # statements
    def statement(self) -> Any:
        w = self.word()
        if w == "EXPLAIN":
            self.at += 1
            mode = "EXECUTION" if self.take("EXECUTION") else "LOGICAL"
            mode = "JSON" if self.take("JSON") else "VERBOSE" if self.take("VERBOSE") else mode
            if self.word() not in ("SELECT", "DELETE"):
                self.fail("EXPLAIN takes SELECT or DELETE")
            out = N.Explain(self.statement(), mode)
            return out
        out = {"SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "DESCRIBE": self.show, "SHOW": self.show, "CREATE": self.create, "DROP": self.drop, "ALTER": self.alter, "CHECK": self.check}.get(w, lambda: self.fail("unknown statement"))()
        if self.at < len(self.tokens):
            self.fail("unexpected text after the statement")
        return out

    def where(self) -> Any:
        return self.expr() if self.take("WHERE") else None

    def tail(self, offset: bool = True) -> tuple:
        order = self.commas(self.order_term) if self.take("ORDER", "BY") else ()
        limit = self.number() if self.take("LIMIT") else None
        off = self.number() if offset and self.take("OFFSET") else None
        if self.word() in ("ORDER", "LIMIT"):
            self.fail("ORDER BY, LIMIT and OFFSET come in this order")
        return order, limit, off

    def order_term(self) -> N.Order:
        e = self.expr()
        desc = self.take("DESC")
        if not desc:
            self.take("ASC")
        return N.Order(e, desc)

    def select(self) -> N.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items: tuple = ()
        if not self.take("*"):
            items = self.commas(self.item)
        self.need("FROM")
        entity = self.entity()
        if self.take("AS") or (self.peek()[0] == "name" and self.word() not in RESERVED | UNSUPPORTED):
            self.alias = self.name()
        if self.word() == ",":
            refuse("unsupported", "a statement reads one entity")
        where = self.where()
        group = self.commas(self.path) if self.take("GROUP", "BY") else ()
        having = self.expr() if self.take("HAVING") else None
        order, limit, offset = self.tail()
        return N.Select(entity, items, where, distinct, group, having, order, limit, offset, self.alias)

    def item(self) -> N.Item:
        e = self.expr()
        if isinstance(e, N.Lit):
            refuse("literal_projection", "a literal alone can't be projected")
        alias = None
        if self.take("AS"):
            alias = self.name()
        elif self.peek()[0] == "name" and self.word() not in RESERVED | UNSUPPORTED:
            alias = self.name()
        return N.Item(e, alias)

    def path(self) -> N.Field:
        p = [self.name()]
        while self.take("."):
            p.append(self.name())
        return N.Field(tuple(p))

    def literal(self) -> N.Lit:
        if self.take("DEFAULT"):
            return N.DEFAULT
        e = self.primary()
        if isinstance(e, N.Unary) and e.op == "NEG" and isinstance(e.x, N.Lit):
            e = N.Lit(-e.x.value, e.x.kind)
        if not isinstance(e, N.Lit):
            refuse("literal_expected", "only literals can be assigned")
        return e

    def returning(self) -> tuple | None:
        if not self.take("RETURNING"):
            return None
        return () if self.take("*") else self.commas(self.path)

    def insert(self) -> N.Insert:
        self.need("INSERT", "INTO")
        entity, columns = self.entity(), None
        if self.take("("):
            columns = self.commas(self.name)
            self.need(")")
        if self.take("DEFAULT", "VALUES"):
            return N.Insert(entity, columns, (), None, self.returning())
        if self.word() == "SELECT":
            return N.Insert(entity, columns, None, self.select(), self.returning())
        self.need("VALUES")

        def row() -> tuple:
            self.need("(")
            r = self.commas(self.literal)
            self.need(")")
            return r

        return N.Insert(entity, columns, self.commas(row), None, self.returning())

    def update(self) -> N.Update:
        self.need("UPDATE")
        entity = self.entity()
        self.need("SET")

        def one() -> tuple:
            n = self.name()
            self.need("=")
            return n, self.literal()

        sets = self.commas(one)
        where = self.where()
        order, limit, _ = self.tail(offset=False)
        return N.Update(entity, sets, where, order, limit, self.returning())

    def delete(self) -> N.Delete:
        self.need("DELETE", "FROM")
        entity = self.entity()
        where = self.where()
        order, limit, offset = self.tail()
        return N.Delete(entity, where, order, limit, offset, self.returning())

    def show(self) -> N.Show:
        if self.take("DESCRIBE"):
            entity = self.entity()
            return N.Show("COLUMNS", entity, self.take("VERBOSE"))
        self.need("SHOW")
        for w in ("ENTITIES", "STORES", "MEMORY"):
            if self.take(w):
                return N.Show(w, None, self.take("VERBOSE"))
        for w in ("ENTITY", "COLUMNS", "INDEXES", "RELATIONS", "CONSTRAINTS"):
            if self.take(w):
                self.take("FROM")
                return N.Show(w, self.entity(), self.take("VERBOSE"))
        self.fail("unknown SHOW")

    def create(self) -> N.Ddl:
        self.need("CREATE")
        unique = self.take("UNIQUE")
        self.need("INDEX")
        quiet = self.take("IF", "NOT", "EXISTS")
        name = self.name()
        self.need("ON")
        entity = self.entity()
        self.need("(")

        def key() -> Any:
            if self.word() in ("LOWER", "UPPER", "TRIM") and self.word(1) == "(":
                f = self.word()
                self.at += 2
                p = self.path()
                self.need(")")
                out = N.Func(f, (p,))
            else:
                out = self.path()
            self.take("ASC")
            return out

        keys = self.commas(key)
        self.need(")")
        return N.Ddl("CREATE INDEX", entity, {"name": name, "unique": unique, "quiet": quiet, "keys": keys, "where": self.where()})

    def drop(self) -> N.Ddl:
        self.need("DROP", "INDEX")
        quiet = self.take("IF", "EXISTS")
        name = self.name()
        return N.Ddl("DROP INDEX", self.entity() if self.take("ON") else None, {"name": name, "quiet": quiet})

    def alter(self) -> N.Ddl:
        self.need("ALTER", "TABLE")
        entity = self.entity()
        if self.take("ADD", "COLUMN"):
            name, kind = self.name(), self.name()
            if self.take("("):
                kind += f"({self.number()})"
                self.need(")")
            args = {"name": name, "kind": kind, "nullable": True, "default": None}
            while self.at < len(self.tokens):
                if self.take("DEFAULT"):
                    args["default"] = self.literal()
                elif self.take("NOT", "NULL"):
                    args["nullable"] = False
                else:
                    self.need("NULL")
            return N.Ddl("ADD COLUMN", entity, args)
        if self.take("ALTER", "COLUMN"):
            name = self.name()
            if self.take("SET", "DEFAULT"):
                return N.Ddl("SET DEFAULT", entity, {"name": name, "default": self.literal()})
            for w in (("DROP", "DEFAULT"), ("SET", "NOT", "NULL"), ("DROP", "NOT", "NULL")):
                if self.take(*w):
                    return N.Ddl(" ".join(w), entity, {"name": name})
            self.fail("unknown ALTER COLUMN")
        if self.take("RENAME", "COLUMN"):
            name = self.name()
            self.need("TO")
            return N.Ddl("RENAME COLUMN", entity, {"name": name, "to": self.name()})
        if self.take("DROP", "COLUMN"):
            return N.Ddl("DROP COLUMN", entity, {"name": self.name()})
        if self.take("ADD", "CONSTRAINT"):
            name = self.name()
            self.need("CHECK", "(")
            e = self.expr()
            self.need(")")
            return N.Ddl("ADD CONSTRAINT", entity, {"name": name, "check": e, "valid": not self.take("NOT", "VALID")})
        if self.take("VALIDATE", "CONSTRAINT"):
            name = self.name()
            return N.Ddl("VALIDATE CONSTRAINT", entity, {"name": name, "after": self.number() if self.take("AFTER") else None})
        self.need("DROP", "CONSTRAINT")
        return N.Ddl("DROP CONSTRAINT", entity, {"name": self.name()})

    def check(self) -> N.Ddl:
        self.need("CHECK", "INTEGRITY")
        if self.take("QUICK"):
            return N.Ddl("INTEGRITY", self.entity(), {"mode": "QUICK"})
        self.need("DEEP")
        for w in ("START", "CONTINUE", "ABORT"):
            if self.take(w):
                return N.Ddl("INTEGRITY", self.entity(), {"mode": f"DEEP {w}"})
        self.fail("expected START, CONTINUE or ABORT")

    # expressions: OR 1 < AND 2 < comparison 3 < + - 4 < * / 5
    LEVELS = {"OR": 1, "AND": 2, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5}

    def expr(self, least: int = 1) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            refuse("too_deep", f"expressions nest at most {MAX_DEPTH} deep")
        if self.word() == "NOT" and least <= 3:
            self.at += 1
            left: Any = N.Unary("NOT", self.expr(3))
        else:
            left = self.postfix(self.primary(), least)
        while (level := self.LEVELS.get(self.word(), 0)) >= least:
            op = self.word()
            self.at += 1
            left = N.Binary(op, left, self.expr(level + 1))
            left = self.postfix(left, least) if level > 3 else left
        self.depth -= 1
        return left

    def postfix(self, x: Any, least: int) -> Any:
        while least <= 3:
            if self.take("IS"):
                neg = self.take("NOT")
                for w in ("TRUE", "FALSE"):
                    if self.take(w):
                        x = N.Binary("=", x, N.Lit(w == "TRUE", "bool"))
                        x = N.Unary("NOT", x) if neg else x
                        break
                else:
                    for w in ("NULL", "MISSING", "EMPTY"):
                        if self.take(w):
                            x = N.Test(w, x, neg)
                            break
                    else:
                        self.fail("unknown IS test")
                continue
            neg = self.word() == "NOT" and self.word(1) in ("IN", "BETWEEN", "LIKE", "ILIKE")
            self.at += neg
            if self.take("IN"):
                self.need("(")
                if self.word() == "SELECT":
                    refuse("unsupported", "no subqueries")
                items = []
                while not self.take(")"):
                    items.append(self.literal())
                    if not self.take(",") and self.word() != ")":
                        self.fail("expected , or )")
                if not items:
                    refuse("syntax", "IN takes at least one value")
                x = N.InList(x, tuple(items), neg)
            elif self.take("BETWEEN"):
                low = self.expr(4)
                self.need("AND")
                high = self.expr(4)
                x = N.Binary("OR", N.Binary("<", x, low), N.Binary(">", x, high)) if neg else N.Binary("AND", N.Binary(">=", x, low), N.Binary("<=", x, high))
            elif self.word() in ("LIKE", "ILIKE"):
                fold = self.word() == "ILIKE"
                self.at += 1
                kind, pattern = self.peek()
                if kind != "text" or not pattern.endswith("%") or set(pattern[:-1]) & set("%_"):
                    refuse("like_pattern", "a pattern is a literal text with one % at its end")
                self.at += 1
                fix = N.Lit(pattern[:-1], "text")
                x = N.Func("STARTS_WITH_CI", (x, fix)) if fold else N.Func("STARTS_WITH", (x, fix))
                x = N.Unary("NOT", x) if neg else x
            else:
                break
        return x

    def primary(self) -> Any:
        kind, v = self.peek()
        w = self.word()
        if kind in ("text", "blob"):
            self.at += 1
            return N.Lit(v, kind)
        if kind == "num":
            self.at += 1
            return N.Lit(v, "int" if isinstance(v, int) else "decimal")
        if self.take("("):
            if self.word() == "SELECT":
                refuse("unsupported", "no subqueries")
            e = self.expr()
            self.need(")")
            return e
        if self.take("-"):
            x = self.primary()
            return N.Lit(-x.value, x.kind) if isinstance(x, N.Lit) and x.kind in ("int", "decimal") else N.Unary("NEG", x)
        if w in ("TRUE", "FALSE"):
            self.at += 1
            return N.Lit(w == "TRUE", "bool")
        if self.take("NULL"):
            return N.Lit(None, "null")
        if self.take("CASE"):
            if self.word() != "WHEN":
                refuse("unsupported", "only searched CASE")
            arms = []
            while self.take("WHEN"):
                c = self.expr()
                self.need("THEN")
                arms.append((c, self.expr()))
            default = self.expr() if self.take("ELSE") else None
            self.need("END")
            return N.Case(tuple(arms), default)
        if kind == "name" and self.word(1) == "(":
            return self.call(w)
        if kind == "name" and w not in RESERVED:
            p = self.path()
            if self.alias is None and len(p.path) > 1 or self.alias and p.path[0] == self.alias and len(p.path) > 1:
                return p
            return p
        self.fail("expected an expression")

    def call(self, w: str) -> Any:
        if w in UNSUPPORTED:
            refuse("unsupported", w)
        self.at += 2
        if w in N.AGGREGATES:
            distinct, arg = self.take("DISTINCT"), None
            if w == "COUNT" and not distinct and self.take("*"):
                pass
            elif w in ("MIN", "MAX") and self.word() == ")":
                refuse("syntax", f"{w} takes an argument")
            else:
                arg = self.expr()
                if N.has_aggregate(arg):
                    refuse("nested_aggregate", "an aggregate's input has no aggregates")
            self.need(")")
            where = None
            if self.take("FILTER"):
                self.need("(", "WHERE")
                where = self.expr()
                self.need(")")
            if distinct and where is not None:
                refuse("distinct_filter", "DISTINCT and FILTER don't go together")
            out: Any = N.Agg(w, arg, distinct, where)
        elif w in FUNCTIONS:
            args = () if self.word() == ")" else self.commas(self.expr)
            self.need(")")
            out = N.Func(w, args)
        else:
            refuse("unknown_function", w)
        if self.word() == "OVER":
            refuse("unsupported", "no window functions")
        return out


def parse(text: str) -> Any:
    """The statement of a text."""
    return Parser(text).statement()
