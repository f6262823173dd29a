"""Query strings of search engines, compiled to Columns that scans can evaluate.

    status:200 AND (method:GET OR method:POST) AND NOT path:\\/internal*
    +level:error -service:"billing core" took:[100 TO 500} _exists_:user props.k:>=7

The grammar, loosest first:

    sequence  := clause (["OR" | "||"] clause)*        clause := ["+" | "-"] both
    both      := single (("AND" | "&&") single)*       single := ("NOT" | "!" | "-" | "+") single | primary
    primary   := "(" sequence ")" | [field ":"] value
    value     := "(" sequence ")" | range | comparison | phrase | word | "/" pattern "/"
    range     := ("[" | "{") bound "TO" bound ("]" | "}")      comparison := (">" | ">=" | "<" | "<=") word

Operators are upper-case words. In a sequence with "+" clauses the others but
"-" are optional; without one, some clause must hold, or all with
``default_and``. A backslash takes the next character literally; ``*`` and ``?``
are wildcards. A boost ``^2`` only orders results and is read over; fuzzy ``~``
is refused. Clauses without a field are searched in the default fields.

Values follow the column's type. Times take ISO instants of any precision, and
mean their whole year, month, day or second. A column named in ``analyzed`` is
matched by words in any case, other text whole. ``a.b`` is a struct's field or a
path into JSON text. As in a search engine, a negation also matches rows without
a value; it is pushed down to the comparisons so that scans see them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import MissingColumns, SpecError

#: Characters that end a word unless escaped.
_ENDS = ' \t\r\n()[]{}":^~'
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Word:
    """Characters of a value and whether each was escaped; a phrase has none that counts as a wildcard."""

    text: str
    literal: tuple[bool, ...]
    at: int
    phrase: bool = False

    @property
    def wild(self) -> bool:
        return any(c in "*?" and not kept for c, kept in zip(self.text, self.literal, strict=True))

    def pieces(self) -> list[tuple[str, bool]]:
        """Runs of literal text and single wildcards."""
        out: list[tuple[str, bool]] = []
        for c, kept in zip(self.text, self.literal, strict=True):
            wild = c in "*?" and not kept
            if out and not wild and not out[-1][1]:
                out[-1] = (out[-1][0] + c, False)
            else:
                out.append((c, wild))
        return out


@dataclass(frozen=True)
class Leaf:
    """A leaf: ``kind`` is is, exists, pattern or range (low, high, whether each end counts)."""

    field: str | None
    kind: str
    word: Word | None = None
    low: Word | None = None
    high: Word | None = None
    with_low: bool = True
    with_high: bool = True
    at: int = 0


@dataclass(frozen=True)
class Group:
    """``kind`` is and, or, not, all."""

    kind: str
    parts: tuple[Any, ...] = field(default=())


def _failed(message: str, at: int) -> SpecError:
    return SpecError(f"{message} at position {at}")


class _Parser:
    def __init__(self, text: str, default_and: bool) -> None:
        self.text, self.at, self.default_and = text, 0, default_and

    # characters

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def take(self, *tokens: str) -> bool:
        """Read over one of the symbols."""
        self.blanks()
        for token in tokens:
            if self.peek(token):
                self.at += len(token)
                return True
        return False

    def take_word(self, *words: str) -> bool:
        """Read over one of the operators that are words."""
        self.blanks()
        for word in words:
            after = self.at + len(word)
            if self.peek(word) and (after == len(self.text) or self.text[after].isspace() or self.text[after] in '()"+-!'):
                self.at = after
                return True
        return False

    def expect(self, *tokens: str) -> str:
        self.blanks()
        for token in tokens:
            if self.take(token):
                return token
        raise _failed(f"expected {' or '.join(tokens)}", self.at)

    def at_end(self) -> bool:
        self.blanks()
        return self.at >= len(self.text) or self.peek(")")

    # clauses

    def whole(self) -> Any:
        if self.at_end() and self.at >= len(self.text):
            return Group("all")
        made = self.sequence(None)
        if self.at < len(self.text):
            raise _failed("unbalanced )", self.at)
        return made

    def sequence(self, name: str | None) -> Any:
        must, never, maybe = [], [], []
        while True:
            wanted = self.sign()
            (must if wanted == "+" else never if wanted == "-" else maybe).append(self.both(name))
            if self.at_end():
                break
            if self.take_word("OR") or self.take("||"):
                if self.at_end():
                    raise _failed("a clause is missing", self.at)
        parts = [*must, *(Group("not", (x,)) for x in never)]
        if maybe and not must:
            parts.append(maybe[0] if len(maybe) == 1 else Group("or", tuple(maybe)))
        return parts[0] if len(parts) == 1 else Group("and", tuple(parts))

    def sign(self) -> str:
        self.blanks()
        if self.at + 1 < len(self.text) and self.text[self.at] in "+-" and not self.text[self.at + 1].isspace():
            self.at += 1
            return self.text[self.at - 1]
        return ""

    def both(self, name: str | None) -> Any:
        parts = [self.single(name)]
        while True:
            if self.take_word("AND") or self.take("&&"):
                if self.at_end():
                    raise _failed("a clause is missing", self.at)
            elif not self.default_and or self.at_end() or self.peek("||") or self.text[self.at] in "+-" or self.ahead("OR"):
                break
            parts.append(self.single(name))
        return parts[0] if len(parts) == 1 else Group("and", tuple(parts))

    def ahead(self, word: str) -> bool:
        at = self.at
        found = self.take_word(word)
        self.at = at
        return found

    def single(self, name: str | None) -> Any:
        if self.take_word("NOT") or self.take("!"):
            return Group("not", (self.single(name),))
        sign = self.sign()
        if sign:
            inner = self.single(name)
            return Group("not", (inner,)) if sign == "-" else inner
        return self.primary(name)

    def primary(self, name: str | None) -> Any:
        self.blanks()
        if self.at_end():
            raise _failed("a clause is missing", self.at)
        for word in ("AND", "OR", "TO"):
            if self.ahead(word):
                raise _failed(f"{word} without a clause before it", self.at)
        if self.peek("(") or self.peek('"') or self.peek("[") or self.peek("{") or self.peek("/"):
            return self.value(name)
        if name is None or self.named():
            begin = self.at
            word = self.word()
            if self.peek(":"):
                if word.wild and word.text != "*":
                    raise _failed("a field's name has no wildcards", begin)
                self.at += 1
                if word.text == "_exists_":
                    self.blanks()
                    return Leaf(self.word().text, "exists", at=begin)
                return self.value(word.text)
            self.at = begin
        return self.value(name)

    def named(self) -> bool:
        """Whether a field's name comes next."""
        begin = self.at
        try:
            self.word()
            return self.peek(":")
        except SpecError:
            return False
        finally:
            self.at = begin

    # values

    def value(self, name: str | None) -> Any:
        self.blanks()
        begin = self.at
        if begin >= len(self.text):
            raise _failed("a value is missing", begin)
        if self.take("("):
            if self.at_end():
                raise _failed("a clause is missing", self.at)
            made = self.sequence(name)
            self.expect(")")
            self.boost()
            return made
        if self.peek("[") or self.peek("{"):
            made = self.range(name)
        elif self.peek("/"):
            made = Leaf(name, "pattern", self.slashed(), at=begin)
        elif sign := next((s for s in (">=", "<=", ">", "<") if self.peek(s)), ""):
            self.at += len(sign)
            self.blanks()
            bound = self.bound("()")
            if bound is None:
                raise _failed("a bound is missing", begin)
            low = sign[0] == ">"
            made = Leaf(name, "range", low=bound if low else None, high=None if low else bound, with_low=sign == ">=", with_high=sign == "<=", at=begin)
        else:
            word = self.quoted() if self.peek('"') else self.word()
            if name == "*" and word.text == "*":
                made = Group("all")
            else:
                made = Leaf(name, "exists" if word.wild and word.text == "*" and name else "is", word, at=begin)
        self.boost()
        return made

    def boost(self) -> None:
        if self.peek("~"):
            raise _failed("fuzzy terms are not supported", self.at)
        if self.peek("^"):
            begin = self.at
            self.at += 1
            found = re.compile(r"\d+(\.\d+)?").match(self.text, self.at)
            if not found:
                raise _failed("a boost is a number", begin)
            self.at = found.end()

    def word(self) -> Word:
        begin, text, kept = self.at, [], []
        while self.at < len(self.text) and self.text[self.at] not in _ENDS:
            c = self.text[self.at]
            if c == "\\":
                self.at += 1
                if self.at == len(self.text):
                    raise _failed("nothing to escape", self.at - 1)
                c = self.text[self.at]
                text.append(c)
                kept.append(True)
            else:
                text.append(c)
                kept.append(False)
            self.at += 1
        if not text:
            raise _failed("unexpected " + (repr(self.text[self.at]) if self.at < len(self.text) else "end"), self.at)
        return Word("".join(text), tuple(kept), begin)

    def quoted(self) -> Word:
        begin, text = self.at, []
        self.at += 1
        while self.at < len(self.text) and self.text[self.at] != '"':
            self.at += self.text[self.at] == "\\" and self.at + 1 < len(self.text)
            text.append(self.text[self.at])
            self.at += 1
        if self.at == len(self.text):
            raise _failed("a phrase is not closed", begin)
        self.at += 1
        return Word("".join(text), (True,) * len(text), begin, True)

    def slashed(self) -> Word:
        begin, text = self.at, []
        self.at += 1
        while self.at < len(self.text) and self.text[self.at] != "/":
            if self.peek("\\/"):
                self.at += 1
            elif self.peek("\\") and self.at + 1 < len(self.text):
                text.append("\\")
                self.at += 1
            text.append(self.text[self.at])
            self.at += 1
        if self.at == len(self.text):
            raise _failed("a pattern is not closed", begin)
        self.at += 1
        try:
            re.compile("".join(text))
        except re.error as e:
            raise _failed(f"bad pattern ({e.msg})", begin) from e
        return Word("".join(text), (True,) * len(text), begin)

    def range(self, name: str | None) -> Leaf:
        begin = self.at
        opened = self.expect("[", "{")
        low = self.bound()
        if not self.take_word("TO"):
            raise _failed("expected TO", self.at)
        high = self.bound()
        closed = self.expect("]", "}")
        return Leaf(name, "range", low=low, high=high, with_low=opened == "[", with_high=closed == "]", at=begin)

    def bound(self, ends: str = "]}[{") -> Word | None:
        """One end of a range; it may hold colons, as times do. An open end is none."""
        self.blanks()
        if self.peek('"'):
            return self.quoted()
        begin, text = self.at, []
        while self.at < len(self.text) and not self.text[self.at].isspace() and self.text[self.at] not in ends:
            self.at += self.text[self.at] == "\\" and self.at + 1 < len(self.text)
            text.append(self.text[self.at])
            self.at += 1
        if not text or text == ["T", "O"]:
            raise _failed("a bound is missing", begin)
        return None if text == ["*"] else Word("".join(text), (True,) * len(text), begin)


def parse(text: str, default_and: bool = False) -> Any:
    """The tree of a query string; raises SpecError with the position of what is wrong."""
    return _Parser(text, default_and).whole()


# columns ------------------------------------------------------------------

_TIME = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(\.\d{1,6})?)?)?Z?)?)?)?$")


def _span(word: Word) -> tuple[datetime, datetime]:
    """The first instant of a time and the first after it."""
    m = _TIME.match(word.text)
    if not m:
        raise _failed(f"not a time: {word.text!r}", word.at)
    parts = [int(x) if x else None for x in m.groups()[:6]]
    try:
        start = datetime(parts[0], parts[1] or 1, parts[2] or 1, parts[3] or 0, parts[4] or 0, parts[5] or 0, int(float(m[7] or 0) * 1e6 + 0.5), UTC)
    except ValueError as e:
        raise _failed(f"not a time: {word.text!r}", word.at) from e
    known = sum(x is not None for x in parts)
    if known == 1:
        return start, start.replace(year=start.year + 1)
    if known == 2:
        return start, start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    step = {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1)}.get(known, timedelta(microseconds=1) if m[7] else timedelta(seconds=1))
    return start, start + step


class _Compiler:
    def __init__(self, df: DataFrame, default_fields: list[str], analyzed: list[str]) -> None:
        self.df, self.default_fields, self.analyzed = df, default_fields, set(analyzed)
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def column(self, name: str) -> tuple[Column, T.DataType, bool]:
        """A field as a Column, its type, and whether it is a path into JSON text, whose numbers are text."""
        if name in self.types:
            return F.col(f"`{name}`"), self.types[name], False
        root, *path = name.split(".")
        kind = self.types.get(root)
        if kind is None or not path:
            raise MissingColumns([name])
        column = F.col(f"`{root}`")
        while path and isinstance(kind, T.StructType):
            if path[0] not in kind.names:
                raise MissingColumns([name])
            kind, column = kind[path[0]].dataType, column[path.pop(0)]
        if not path:
            return column, kind, False
        if isinstance(kind, T.StringType):
            return F.get_json_object(column, "$." + ".".join(path)), T.StringType(), True
        raise MissingColumns([name])

    def compile(self, node: Any, holds: bool = True) -> Column:
        """The node, or its negation, which missing values satisfy."""
        if isinstance(node, Leaf):
            names = [node.field] if node.field is not None else self.default_fields
            if not names:
                raise _failed("no default field for a clause without a field", node.at)
            tests = [self.leaf(node, name, holds) for name in names]
            return reduce(or_ if holds else and_, tests)
        if node.kind == "all":
            return F.lit(holds)
        if node.kind == "not":
            return self.compile(node.parts[0], not holds)
        parts = [self.compile(p, holds) for p in node.parts]
        return reduce(and_ if (node.kind == "and") == holds else or_, parts)

    def leaf(self, node: Leaf, name: str, holds: bool) -> Column:
        column, kind, loose = self.column(name)
        if node.kind == "exists":
            return column.isNotNull() if holds else column.isNull()
        if isinstance(kind, T.ArrayType):  # some element
            test = F.exists(column, lambda x: F.coalesce(self.test(node, x, kind.elementType, name, False), F.lit(False)))
        else:
            test = self.test(node, column, kind, name, loose)
        return test if holds else ~test | column.isNull()

    def test(self, node: Leaf, column: Column, kind: T.DataType, name: str, loose: bool) -> Column:
        text = isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
        if node.kind == "range":
            return self.between(node, column, kind, text, loose)
        if node.kind == "pattern":
            return column.cast("string").rlike(f"^(?:{node.word.text})$")
        word = node.word
        if text and name in self.analyzed:
            return self.words(word, column)
        if word.wild:
            return self.wildcards(word, column if text else column.cast("string"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return self.between(Leaf(name, "range", low=word, high=word), column, kind, text, loose)
        return column == self.literal(word, kind)

    @staticmethod
    def literal(word: Word, kind: T.DataType) -> Column:
        """A value of the column's own type, so that the column itself is compared and scans take the filter."""
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            return F.lit(word.text)
        if isinstance(kind, T.BooleanType):
            if word.text not in ("true", "false"):
                raise _failed(f"not a truth value: {word.text!r}", word.at)
            return F.lit(word.text == "true")
        try:
            if isinstance(kind, _NUMBERS):
                return F.lit(int(word.text)) if abs(int(word.text)) < 1 << 31 else F.lit(int(word.text)).cast("long")
            return F.lit(Decimal(word.text)).cast(kind) if isinstance(kind, T.DecimalType) else F.lit(float(word.text)).cast(kind)
        except (ValueError, InvalidOperation) as e:
            raise _failed(f"not a number: {word.text!r}", word.at) from e

    def between(self, node: Leaf, column: Column, kind: T.DataType, text: bool, loose: bool) -> Column:
        tests = []
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            # a bound means its whole span: from its start if it counts, else from what follows it
            if node.low is not None:
                tests.append(column >= F.lit(self.moment(_span(node.low)[0 if node.with_low else 1], kind)))
            if node.high is not None:
                tests.append(column < F.lit(self.moment(_span(node.high)[1 if node.with_high else 0], kind)))
        else:
            number = T.DoubleType()
            for bound, counts, low in ((node.low, node.with_low, True), (node.high, node.with_high, False)):
                if bound is None:
                    continue
                plain = loose and re.fullmatch(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", bound.text)
                side = column.try_cast("double") if plain else column
                value = self.literal(bound, number if plain or (isinstance(kind, _NUMBERS) and "." in bound.text) else kind)
                tests.append((side >= value if counts else side > value) if low else (side <= value if counts else side < value))
        return reduce(and_, tests) if tests else column.isNotNull()

    @staticmethod
    def moment(at: datetime, kind: T.DataType) -> Any:
        if isinstance(kind, T.DateType):
            return (at + timedelta(days=1) - timedelta(microseconds=1)).date()
        return at if isinstance(kind, T.TimestampType) else at.replace(tzinfo=None)

    @staticmethod
    def wildcards(word: Word, column: Column) -> Column:
        """Prefixes, suffixes and inner parts as such, which scans know; other patterns as LIKE."""
        pieces = word.pieces()
        stars = [i for i, (c, wild) in enumerate(pieces) if wild]
        solid = [c for c, wild in pieces if not wild]
        if all(pieces[i][0] == "*" for i in stars) and len(solid) == 1:
            if stars == [1]:
                return column.startswith(solid[0])
            if stars == [0] and len(pieces) == 2:
                return column.endswith(solid[0])
            if stars == [0, 2]:
                return column.contains(solid[0])
        escaped = "".join({"*": "%", "?": "_"}[c] if wild else re.sub(r"([\\%_])", r"\\\1", c) for c, wild in pieces)
        return column.like(escaped)

    @staticmethod
    def words(word: Word, column: Column) -> Column:
        """A word, or the words of a phrase one after another, among the words of a text in any case."""
        if word.phrase:
            parts = [re.escape(x) for x in re.findall(r"\w+", word.text)]
        else:
            parts = ["".join((r"\w*" if c == "*" else r"\w") if wild else re.escape(c) for c, wild in word.pieces())]
        return column.rlike(r"(?iU)(?<!\w)" + r"\W+".join(parts) + r"(?!\w)")


def query_column(df: DataFrame, text: str, default_fields: list[str] | None = None, analyzed: list[str] | None = None, default_and: bool = False) -> Column:
    """A query string as a condition on a relation's columns."""
    return _Compiler(df, default_fields or [], analyzed or []).compile(parse(text, default_and))


def query_filter(
    df: DataFrame, text: str | None = None, ts: str | None = None, start: Any = None, end: Any = None, fields: list[str] | None = None, analyzed: list[str] | None = None, **equal: Any
) -> DataFrame:
    """Rows of a query string (all without one), of the given equalities, and with a time in [start, end]."""
    tests = [F.col(f"`{k}`") == v for k, v in equal.items()]
    tests += [F.col(ts) >= start] if ts and start is not None else []
    tests += [F.col(ts) <= end] if ts and end is not None else []
    if text is not None and text.strip():
        tests.append(query_column(df, text, fields, analyzed))
    return df.where(reduce(and_, tests)) if tests else df
