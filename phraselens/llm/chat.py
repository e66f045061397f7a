"""Chat formatting with a small sandboxed template language, compiled to closures.

    {{ expression }}   {% for x in expression %} ... {% endfor %}   {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = expression %}   {% generation %} ... {% endgeneration %}   {# remark #}

Expressions know literals, names, x.key and x['key'], + == != < > in not and or, parentheses and the filters trim, upper,
lower and length. Names are the conversation's messages (with role and content), what the template sets and, in a loop,
loop.index, loop.first and loop.last. There are no calls, and keys are looked up in mappings only, so a template reaches
nothing else. A template is parsed to a tree, constant parts of the tree are computed once, and every node becomes a
closure. Rendering gives the text and the spans written inside generation blocks, which are the loss mask.

Texts cannot forge turns: in every role and text, a backslash is doubled and a backslash is put behind each character
that starts a control string, so no control string is left in it; unescape takes both back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The control strings of the default template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for message in messages %}{{ '<s>' }}"
    "{% if message.role == 'user' %}[INST]{{ message.content }}[/INST]"
    "{% elif message.role == 'system' %}[SYS]{{ message.content }}[/SYS]"
    "{% elif message.role == 'assistant' %}{% generation %}{{ message.content }}{% endgeneration %}"
    "{% else %}[ROLE]{{ message.role }}[/ROLE]{{ message.content }}{% endif %}"
    "{{ '</s>' }}{% endfor %}"
)
TURN = re.compile(r"<s>(?:\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)|(?P<assistant>.*?))</s>", re.S)

PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+<>()\[\].|=]))""", re.S)
FILTERS = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
BINARY = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "in": lambda a, b: a in b, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "in"), ("+",))
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not in the language."""


class _Expression:
    """A recursive-descent parser of one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str:
        kind, value = self.peek()
        if values and (value not in values or kind == "text"):
            raise TemplateError(f"expected {values}, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        node = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, n: int) -> tuple:
        if n == len(LEVELS):
            return self.postfix()
        if n == 2 and self.peek() == ("name", "not"):
            self.take()
            return ("not", self.level(n))
        node = self.level(n + 1)
        while self.peek()[0] in ("sign", "name") and self.peek()[1] in LEVELS[n]:
            node = ("binary", self.take(), node, self.level(n + 1))
        return node

    def postfix(self) -> tuple:
        kind, value = self.peek()
        self.take()
        if kind == "text":
            node = ("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            node = ("constant", int(value))
        elif kind == "name" and value in ("true", "false", "none"):
            node = ("constant", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = ("name", value)
        elif value == "(":
            node = self.level(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[0] == "sign" and self.peek()[1] in ".[|":
            sign = self.take()
            if sign == "[":
                node = ("key", node, self.level(0))
                self.take("]")
            else:
                kind, name = self.peek()
                self.take()
                if kind != "name" or (sign == "|" and name not in FILTERS):
                    raise TemplateError(f"unknown {name!r}")
                node = ("filter", name, node) if sign == "|" else ("key", node, ("constant", name))
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", [nodes])."""
    parts, at = [p for p in PARTS.split(source) if p], 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("print", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), f"{word} {rest}".strip()
                nodes.append(statement(word, rest))
            elif not part.startswith("{#"):
                nodes.append(("print", ("constant", part)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", nodes), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            name, found, values = (x.strip() for x in rest.partition(" in "))
            if not found or not name.isidentifier():
                raise TemplateError(f"for {rest}")
            return ("for", name, _Expression(values).whole(), block("endfor")[0])
        if word == "if":
            cases, condition = [], _Expression(rest).whole()
            while True:
                body, end = block("elif", "else", "endif")
                cases.append((condition, body))
                if not end.startswith("elif"):
                    return ("if", cases, block("endif")[0] if end == "else" else ("block", []))
                condition = _Expression(end[4:]).whole()
        if word == "set":
            name, found, value = (x.strip() for x in rest.partition("="))
            if not found or not name.isidentifier():
                raise TemplateError(f"set {rest}")
            return ("set", name, _Expression(value).whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")
    return block()[0]


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, dead branches dropped and neighbouring constant texts joined."""
    kind = node[0]
    if kind in ("constant", "name"):
        return node
    if kind in ("print", "generation", "not"):
        inner = fold(node[1])
        return ("constant", not inner[1]) if kind == "not" and inner[0] == "constant" else (kind, inner)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "filter":
        inner = fold(node[2])
        return ("constant", FILTERS[node[1]](inner[1])) if inner[0] == "constant" else ("filter", node[1], inner)
    if kind == "key":
        return ("key", fold(node[1]), fold(node[2]))
    if kind == "binary":
        a, b = fold(node[2]), fold(node[3])
        return ("constant", BINARY[node[1]](a[1], b[1])) if a[0] == b[0] == "constant" else ("binary", node[1], a, b)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        cases, rest = [], fold(node[2])
        for condition, body in ((fold(c), fold(b)) for c, b in node[1]):
            if condition[0] != "constant":
                cases.append((condition, body))
            elif condition[1]:
                rest = body
                break
        return ("if", cases, rest) if cases else rest
    nodes: list[tuple] = []
    for x in map(fold, node[1]):
        for y in x[1] if x[0] == "block" else [x]:
            if y[0] == "print" and y[1][0] == "constant" and nodes and nodes[-1][0] == "print" and nodes[-1][1][0] == "constant":
                nodes[-1] = ("print", ("constant", str(nodes[-1][1][1]) + str(y[1][1])))
            else:
                nodes.append(y)
    return ("block", nodes)


class _Output:
    """Pieces of the text, its length so far and the spans of the generation blocks."""

    def __init__(self):
        self.pieces, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node: tuple):
    """A closure scope -> value."""
    kind = node[0]
    if kind == "constant":
        return lambda scope: node[1]
    if kind == "name":
        def name(scope):
            if node[1] not in scope:
                raise TemplateError(f"unknown name {node[1]!r}")
            return scope[node[1]]
        return name
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        apply, inner = FILTERS[node[1]], _value(node[2])
        return lambda scope: apply(inner(scope))
    if kind == "key":
        holder, key = _value(node[1]), _value(node[2])

        def get(scope):
            found = holder(scope)
            if not isinstance(found, dict):
                raise TemplateError("only messages and loop have keys")
            return found.get(key(scope))
        return get
    left, right = _value(node[2]), _value(node[3])
    if node[1] in ("and", "or"):
        return (lambda s: left(s) and right(s)) if node[1] == "and" else (lambda s: left(s) or right(s))
    apply = BINARY[node[1]]
    return lambda scope: apply(left(scope), right(scope))


def _writer(node: tuple):
    """A closure (scope, output) -> None."""
    kind = node[0]
    if kind == "print":
        if node[1][0] == "constant":
            text = str(node[1][1])
            return lambda scope, out: out.write(text)
        value = _value(node[1])
        return lambda scope, out: out.write("" if (v := value(scope)) is None else str(v))
    if kind == "set":
        value = _value(node[2])
        return lambda scope, out: scope.__setitem__(node[1], value(scope))
    if kind == "generation":
        body = _writer(node[1])

        def generation(scope, out):
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))
        return generation
    if kind == "if":
        cases, rest = [(_value(c), _writer(b)) for c, b in node[1]], _writer(node[2])

        def choose(scope, out):
            next((body for condition, body in cases if condition(scope)), rest)(scope, out)
        return choose
    if kind == "for":
        values, body = _value(node[2]), _writer(node[3])

        def loop(scope, out):
            items = values(scope)
            for i, item in enumerate(items):
                body({**scope, node[1]: item, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)
        return loop
    writers = [_writer(x) for x in node[1]]

    def block(scope, out):
        for write in writers:
            write(scope, out)
    return block


def compile_template(source: str):
    """A function messages -> (text, spans)."""
    write = _writer(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"messages": messages}, out)
        return "".join(out.pieces), out.spans
    return render


def escaper(controls: tuple[str, ...]):
    starts = re.compile("([" + re.escape("".join(sorted({c[0] for c in controls}))) + "])")
    return lambda text: starts.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaper(controls: tuple[str, ...]):
    marks = re.compile("([" + re.escape("".join(sorted({c[0] for c in controls}))) + r"])\\|\\\\")
    return lambda text: marks.sub(lambda m: m[1] or "\\", text)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _formatter(template: str, controls: tuple[str, ...]):
    def format_(batches):
        render, escape = compile_template(template), escaper(controls)
        for batch in batches:
            texts, spans = [], []
            for turns in batch["turns"].to_pylist():
                text, found = render([{"role": escape(t["role"]), "content": escape(t["text"])} for t in turns])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(texts), pa.array(spans, SPANS)], ["conv_id", "formatted", "loss_spans"])
    return format_


def _reader(controls: tuple[str, ...]):
    def read(batches):
        unescape = unescaper(controls)
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist()):
                found = []
                for m in TURN.finditer(text):
                    role = next(k for k in ("user", "system", "role", "assistant") if m[k] is not None)
                    found.append({"role": unescape(m["role"]), "text": unescape(m["text"])} if role == "role" else
                                 {"role": role, "text": unescape(m[role])})
                turns.append(found)
                losses.append("".join(unescape(text[s["start"]:s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["formatted"], batch["loss_spans"], pa.array(turns, TURNS), pa.array(losses)],
                ["conv_id", "formatted", "loss_spans", "turns", "loss_text"])
    return read


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end in code points): one row per conversation of a table with conv_id, turn, role, text.

    A conversation's rows go by turn, then role, then text, missing ones first; missing roles and texts are empty. A row
    without a conv_id is a conversation of its own. A conversation is one row of the result and has to fit into one.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cells = rows.select("conv_id", turn.alias("t"))
    whole = cells.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    single = cells.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return whole.unionAll(single).mapInArrow(
        _formatter(template, controls), f"conv_id {kind}, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """The formatted rows with turns (role, text) and loss_text read from formatted and loss_spans (default template)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _reader(controls), f"conv_id {kind}, formatted string, loss_spans array<struct<start:long,end:long>>, "
                           "turns array<struct<role:string,text:string>>, loss_text string")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the format."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(format_conversations(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _digest(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), _digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
