"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes
nested Python closures. The language has text, ``{{ expression }}``, ``{% if %} /
{% elif %} / {% else %}``, ``{% for x in xs %}`` and ``{% generation %}``, whose output
is what a model learns from. Expressions are literals, names, fields of a record,
``loop.first/last/index``, comparisons, ``and``/``or``/``not``, ``+`` and ``~``, and the
filters ``upper``, ``lower``, ``trim`` and ``escape``. No call, index or attribute of a
Python object can be reached, so templates are safe to take from outside.

A compiled template renders a stream of records into a stream of (text, learned) parts:
only the record in hand is in memory, whatever a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded

#: Turn marks. Fixed values of this format; all are escaped in texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<' + 's>' }}[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% elif m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</' ~ 's>' }}"
    "{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """No control string is left in the result, and ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class TemplateError(ValueError):
    pass


# --- syntax tree: tuples (kind, ...) --------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.~+()]))")
_FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": escape}
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in an expression: {source[at : at + 20]!r}")
        if m[1] is not None:
            out.append(("value", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1][1:-1])))
        elif m[2] is not None:
            out.append(("value", int(m[2])))
        elif m[3] is not None:
            out.append(("word" if m[3] in _WORDS else "name", m[3]))
        else:
            out.append(("sign", m[4]))
        at = m.end()
    return out


class _Expression:
    """Precedence: or, and, not, comparison, + and ~, filters and fields."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: object) -> object | None:
        kind, value = self.peek()
        if kind in ("sign", "word") and value in wanted:
            self.at += 1
            return value
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while op := self.take("==", "!="):
            tree = (op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = ("~" if op == "~" else "+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while op := self.take(".", "|"):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a name is missing")
            self.at += 1
            if op == "|" and name not in _FILTERS:
                raise TemplateError(f"no such filter: {name}")
            tree = ("field" if op == "." else "filter", tree, name)
        return tree

    def single(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "value":
            return ("const", value)
        if kind == "name":
            return ("name", value)
        if kind == "word" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if (kind, value) == ("sign", "("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return tree
        raise TemplateError("an expression is missing")


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of statements."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # (tag, its parts, statements being read)
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(("print", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].partition(" ")
        tag, parts, body = stack[-1]
        if word == "if":
            stack.append(("if", [], []))
            stack[-1][1].append(_Expression(rest).whole())
        elif word in ("elif", "else") and tag == "if":
            stack[-1] = ("if", [*parts, body, _Expression(rest).whole() if word == "elif" else ("const", True)], [])
        elif word == "endif" and tag == "if":
            stack.pop()
            flat = [*parts, body]
            stack[-1][2].append(("if", list(zip(flat[::2], flat[1::2]))))
        elif word == "for" and (f := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", rest)):
            stack.append(("for", [f[1], f[2]], []))
        elif word == "endfor" and tag == "for":
            stack.pop()
            stack[-1][2].append(("for", parts[0], parts[1], body))
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == "endgeneration" and tag == "generation":
            stack.pop()
            stack[-1][2].append(("generation", body))
        else:
            raise TemplateError(f"unexpected tag: {m[2]!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[0][2].append(("text", source[at:]))
    return stack[0][2]


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    "~": lambda a, b: _shown(a) + _shown(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b),
}


def fold(tree: tuple) -> tuple:
    """Expressions of constants become constants."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("field", "filter"):
        inner = fold(tree[1])
        return ("const", _FILTERS[tree[2]](_shown(inner[1]))) if kind == "filter" and inner[0] == "const" else (kind, inner, tree[2])
    parts = [fold(t) for t in tree[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", not parts[0][1] if kind == "not" else _BINARY[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def fold_body(body: list[tuple]) -> list[tuple]:
    """Constant prints become text, dead branches go, adjoining text is one."""
    out: list[tuple] = []
    for s in body:
        if s[0] == "print":
            e = fold(s[1])
            s = ("text", _shown(e[1])) if e[0] == "const" else ("print", e)
        elif s[0] == "if":
            arms = []
            for test, inner in s[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    _add(out, inner)
                continue
            s = ("if", arms)
        elif s[0] == "for":
            s = ("for", s[1], s[2], fold_body(s[3]))
        elif s[0] == "generation":
            s = ("generation", fold_body(s[1]))
        _add(out, s)
    return out


def _add(out: list[tuple], s: tuple) -> None:
    if s[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + s[1])
    elif s != ("text", ""):
        out.append(s)


# --- closures -------------------------------------------------------------------------

Part = tuple[str, bool]


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "field":
        inner, name = _value(tree[1]), tree[2]
        return lambda scope: v.get(name) if isinstance(v := inner(scope), dict) else None
    if kind == "filter":
        inner, f = _value(tree[1]), _FILTERS[tree[2]]
        return lambda scope: f(_shown(inner(scope)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    op = _BINARY[kind]
    return lambda scope: op(left(scope), right(scope))


def _body(body: list[tuple], learned: bool = False) -> Callable[[dict], Iterator[Part]]:
    steps = [_statement(s, learned) for s in body]

    def run(scope: dict) -> Iterator[Part]:
        for step in steps:
            yield from step(scope)

    return run


def _statement(s: tuple, learned: bool) -> Callable[[dict], Iterable[Part]]:
    kind = s[0]
    if kind == "text":
        part = ((s[1], learned),)
        return lambda scope: part
    if kind == "print":
        value = _value(s[1])
        return lambda scope: ((_shown(value(scope)), learned),)
    if kind == "generation":
        return _body(s[1], True)
    if kind == "if":
        arms = [(_value(test), _body(inner, learned)) for test, inner in s[1]]
        return lambda scope: next((inner(scope) for test, inner in arms if test(scope)), ())
    _, name, source, inner = s
    inside = _body(inner, learned)

    def loop(scope: dict) -> Iterator[Part]:
        items, index, missing = iter(scope.get(source) or ()), 0, object()
        item = next(items, missing)
        while item is not missing:
            after = next(items, missing)
            index += 1
            yield from inside(scope | {name: item, "loop": {"index": index, "first": index == 1, "last": after is missing}})
            item = after

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Part]]:
    """A function from a scope to parts of output text, each with whether it is learned."""
    return _body(fold_body(parse(source)))


# --- Spark ----------------------------------------------------------------------------

PIECES = "conv_id long, turn_index long, formatted string, loss_start long, loss_end long"


def format_turns(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted text of each conversation, a piece per turn, in order within a partition.

    Turns are dealt by conversation and sorted by turn (nulls first), then role and
    text, so ties have one order; repeated rows are repeated turns. Null roles and
    texts are empty. ``loss_start``/``loss_end`` are code points of the piece under the
    generation mark (both null without one). Concatenating a conversation's pieces gives
    its text. The template has to be one loop over ``messages``, whose ``loop.index``,
    ``loop.first`` and ``loop.last`` are of the whole conversation; turns are rendered as
    they stream by, so a conversation of any length takes the memory of two turns. It is
    read by one task, as its order asks. Very long texts are formatted whole.
    """
    body = fold_body(parse(template))
    if len(body) != 1 or body[0][0] != "for" or body[0][2] != "messages":
        raise TemplateError("a streamed template is one loop over messages")
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, name, _, inner = fold_body(parse(template))[0]
        render = _body(inner)
        held: tuple | None = None  # conversation, index, role and text of the turn whose successor has not come by

        def piece(last: bool) -> tuple:
            conv, index, role, text = held
            parts, at, start, end = [], 0, None, None
            for part, learned in render({name: {"role": role, "text": text}, "loop": {"index": index + 1, "first": index == 0, "last": last}}):
                if learned:
                    start = at if start is None else start
                    end = at + len(part)
                at += len(part)
                parts.append(part)
            return conv, index, "".join(parts), start, end

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(zip(*out))], ["conv_id", "turn_index", "formatted", "loss_start", "loss_end"])

        for block in blocks(batches):
            out = []
            for conv, role, text in zip(block.column("conv_id").to_pylist(), block.column("role").to_pylist(), block.column("text").to_pylist()):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append(piece(not same))
                held = (conv, held[1] + 1 if same else 0, role, text)
            if out:
                yield made(out)
        if held is not None:
            yield made([piece(True)])

    return bounded(dealt).mapInArrow(run, PIECES)


_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("no formatted turn")
    role, text = unescape(m[1]), m[2]
    if role == "user" and text.startswith("[INST]") and text.endswith("[/INST]"):
        text = text[6:-7]
    return role, unescape(text)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted pieces as they stream by (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run
        done: list[tuple] = []
        n = chars = loss = 0
        turns, learned = hashlib.sha256(), hashlib.sha256()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * 6
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], [c.split(" ")[0] for c in READ.split(", ")])
            done.clear()
            return out

        for block in blocks(batches, "formatted"):
            for conv, piece, start, end in zip(*(block.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if conv != last or last is run:
                    if last is not run:
                        done.append((last, n, turns.hexdigest(), loss, learned.hexdigest(), chars))
                    last, n, chars, loss = conv, 0, 0, 0
                    turns, learned = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(piece)
                n += 1
                chars += len(piece)
                turns.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    under = unescape(piece[start:end])
                    loss += len(under)
                    learned.update(under.encode())
            yield batch()
        if last is not run:
            done.append((last, n, turns.hexdigest(), loss, learned.hexdigest(), chars))
            yield batch()

    return bounded(pieces).mapInArrow(run, READ)
