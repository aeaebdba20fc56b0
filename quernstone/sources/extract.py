"""Units of source texts as rows: HTML elements, CSS statements, Python classes and functions.

Each extractor reads (key, text) and gives one row per unit, in document order:
key, ord, symbol, kind, parent (ord of the nearest kept unit around it), start_line,
signature, body_hash, and `error` where the text does not parse. Parsing is a
Python text kernel per document; everything after it is DataFrame work.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that the meaningful profile keeps even without an id, and elements without content.
MEANINGFUL_TAGS = [
    "form", "input", "select", "textarea", "button", "a", "table", "section", "main", "nav", "article", "aside",
    "header", "footer", "dialog", "details", "script", "style",
]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: Elements whose end tag may be left out.
OPTIONAL_END = ["p", "li", "dt", "dd", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body", "head"]

SCHEMA = "ord int, symbol string, kind string, parent int, start_line int, signature string, body_hash string, error boolean"
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: What ends a template's part, by how it begins; and what each of its characters becomes.
_ENDS = {"{%": ("%}", " "), "{#": ("#}", " "), "{{": ("}}", "_")}
_OPENS = re.compile("|".join(map(re.escape, _ENDS)))


def _tag_word(text: str, start: int, stop: int) -> str:
    """First word of the tag between two places."""
    words = re.findall(r"\w+", text[start:stop])
    return words[0] if words and text[start:stop].lstrip().startswith(words[0]) else ""


def mask_templates(text: str) -> str:
    """Text with template tags blanked, expressions as underscores; lengths and line ends stay.

    A comment tag goes with all that stands before its end tag; parts that never
    end stay as they are.
    """
    out, done = [], 0
    opened = [m.start() for m in _OPENS.finditer(text)]
    for k, start in enumerate(opened):
        if start < done:
            continue
        end, filler = _ENDS[text[start:start + 2]]
        stop = text.find(end, start + 2)
        if stop < 0:
            continue
        if end == "%}" and _tag_word(text, start + 2, stop) == "comment":
            for later in opened[k + 1:]:
                close = text.find("%}", later) if later > stop and text.startswith("{%", later) else -1
                if close >= 0 and text[later + 2:close].strip() == "endcomment":
                    stop = close
                    break
        stop += 2
        out += [text[done:start], *(c if c in "\r\n" else filler for c in text[start:stop])]
        done = stop
    return "".join([*out, text[done:]])


def structure_hash(text: str) -> str:
    """Hash of a text's tokens, free of white space."""
    return sha256("\x1f".join(_TOKEN.findall(text)).encode()).hexdigest()


class _Elements(HTMLParser):
    """Elements as [parent, tag, id, start, end, line]."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.broken = False
        self.feed(text)
        self.close()
        for i in self.open:
            self.broken |= self.nodes[i][1] not in OPTIONAL_END
            self.nodes[i][4] = len(text)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        end = at + len(self.get_starttag_text() or "")
        self.nodes.append([self.open[-1] if self.open else -1, tag, dict(attrs).get("id") or None, at, end, self.getpos()[0]])
        if tag not in VOID_TAGS:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID_TAGS:
            return
        if not any(self.nodes[i][1] == tag for i in self.open):
            self.broken = True
            return
        while True:
            i = self.open.pop()
            self.nodes[i][4] = self._at()
            if self.nodes[i][1] == tag:
                return
            self.broken |= self.nodes[i][1] not in OPTIONAL_END


def html_units(text: str, *, meaningful: bool = False) -> list[tuple]:
    """Element units; the symbol is the path `tag[n]` or `tag#id` from the top, the same in both profiles."""
    masked = mask_templates(text)
    parsed = _Elements(masked)
    nth, same_id, with_id = Counter(), Counter(), Counter((p, t, i) for p, t, i, *_ in parsed.nodes if i)
    symbols, kept, out = [], [], []
    for parent, tag, id_, start, end, line in parsed.nodes:
        nth[parent, tag] += 1
        own = f"{tag}[{nth[parent, tag]}]"
        if id_:
            same_id[parent, tag, id_] += 1
            own = f"{tag}#{id_}" + (f"[{same_id[parent, tag, id_]}]" if with_id[parent, tag, id_] > 1 else "")
        symbols.append(f"{symbols[parent]}/{own}" if parent >= 0 else own)
        above = kept[parent] if parent >= 0 else None
        if meaningful and not id_ and tag not in MEANINGFUL_TAGS:
            kept.append(above)
            continue
        kept.append(len(out))
        stop = masked.find(">", start) + 1
        out.append((len(out), symbols[-1], "html_element", above, line, text[start:stop].strip(), structure_hash(text[start:end]), parsed.broken))
    return out or ([(0, None, None, None, 1, None, None, True)] if parsed.broken else [])


def css_units(text: str, *, meaningful: bool = False) -> list[tuple]:
    """Rules, at-rules and keyframe steps, numbered per parent and label; meaningful keeps the top level."""
    plain = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out, stack, counts, head, broken = [], [], Counter(), 0, False
    for m in re.finditer(r"[{};]|\"[^\"\n]*\"|'[^'\n]*'", plain):
        if m[0] == "{":
            label = " ".join(plain[head:m.start()].split())
            around = stack[-1] if stack else None
            keyframe = around is not None and around[1].startswith("@keyframes")
            kind = "css_at_rule" if label.startswith("@") else "css_keyframe" if keyframe else "css_rule"
            counts[around and around[0], label] += 1
            own = f"{label}[{counts[around and around[0], label]}]"
            symbol = f"{around[0]} / {own}" if around else own
            number = None
            if not (meaningful and stack):
                number = len(out)
                start = head + len(plain[head:m.start()]) - len(plain[head:m.start()].lstrip())
                out.append([number, symbol, kind, around[2] if around else None, text.count("\n", 0, start) + 1, label, start, False])
            stack.append((symbol, label, number if number is not None else around[2]))
            head = m.end()
        elif m[0] == "}":
            if not stack:
                broken = True
                continue
            number = stack.pop()[2]
            if number is not None and isinstance(out[number][6], int) and (not stack or stack[-1][2] != number):
                out[number][6] = structure_hash(text[out[number][6]:m.end()])
            head = m.end()
        elif m[0] == ";":
            head = m.end()
    broken |= bool(stack)
    return [(*r[:6], r[6] if isinstance(r[6], str) else structure_hash(text[r[6]:]), broken) for r in out]


def _body_lines(node: ast.AST) -> int:
    """Lines of code in a body, docstring off."""
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    return body[-1].end_lineno - body[0].lineno + 1 if body else 0


def _named(node: ast.expr) -> str:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _holds_data_only(node: ast.ClassDef) -> bool:
    """No methods of instances besides construction."""
    functions = [f for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return not any(f.name not in ("__init__", "__init_subclass__") and not {"staticmethod", "classmethod"} & {_named(d) for d in f.decorator_list} for f in functions)


def _is_shape(node: ast.ClassDef) -> bool:
    """A protocol or an abstract base."""
    return any(_named(d) in ("protocol", "Protocol") for d in node.decorator_list) or any(_named(b) in ("ABC", "ABCMeta") or isinstance(b, ast.Attribute) and "Protocol" in b.attr for b in node.bases)


def python_units(text: str) -> list[tuple]:
    """Public classes, functions and methods; small, private, special and data-only ones are left out."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [(0, None, None, None, 1, None, None, True)]
    out: list[tuple] = []

    def unit(node: ast.AST, symbol: str, kind: str, above: int | None) -> int:
        body = sha256(";".join(ast.dump(s) for s in node.body).encode()).hexdigest()
        out.append((len(out), symbol, kind, above, node.lineno, text.splitlines()[node.lineno - 1].strip(), body, False))
        return len(out) - 1

    def visit(nodes: list[ast.stmt], names: list[str], around: str | None, above: int | None) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                if node.name.startswith("_") or _holds_data_only(node) or _is_shape(node):
                    continue
                here = [*names, node.name]
                visit(node.body, here, "class", unit(node, ".".join(here), "nested_class" if names else "class", above))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                special = node.name.startswith("__") and node.name.endswith("__")
                small = around == "class" and _body_lines(node) < 3 or around == "function" and _body_lines(node) < 5
                if node.name.startswith("_") and not special or small:
                    continue
                here, number = [*names, node.name], above
                if not (around == "class" and special):
                    number = unit(node, ".".join(here), {"class": "method", "function": "nested_function"}.get(around, "function"), above)
                visit(node.body, here, "function", number)

    visit(tree.body, [], None, None)
    return out


_GO_ITEM = re.compile(r"^(?:(type|const|var)\s+(\w+)|func\s+(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?(\w+))", re.M)


def _plain(text: str) -> str:
    """Source of a brace language with comments and texts blanked; lengths and line ends stay."""
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _block_end(plain: str, start: int) -> int:
    """End of what begins at start: its braces, if it has any, else its line."""
    line = plain.find("\n", start)
    line = len(plain) if line < 0 else line
    stop = re.compile(r"[{;]").search(plain, start)
    if stop is None or stop[0] == ";" or "\n" in plain[start:stop.start()].rstrip("\n") and stop.start() > line:
        return line
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, stop.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def go_units(text: str) -> list[tuple]:
    """Types, constants, variables, functions, and methods as `Receiver.method`, of the top level."""
    plain, out = _plain(text), []
    for m in _GO_ITEM.finditer(plain):
        word, name, receiver, function = m.groups()
        symbol = name or (f"{receiver}.{function}" if receiver else function)
        kind = word or ("method" if receiver else "function")
        end = _block_end(plain, m.start())
        broken = end < 0
        body = text[m.start():end if end >= 0 else len(text)]
        out.append((len(out), symbol, kind, None, text.count("\n", 0, m.start()) + 1, body.split("\n", 1)[0].strip(), structure_hash(body), broken))
    return out


_RUST_ITEM = re.compile(r"\b(mod|struct|enum|trait|impl|fn)\b\s*(?:<[^>{]*>\s*)?([^{;(<]*?)\s*(?=[{;(<])")
_RUST_KIND = {"mod": "module"}


def rust_units(text: str) -> list[tuple]:
    """Modules, types, traits, implementations (numbered by what holds them and their name) and functions, with all that holds them in the symbol."""
    plain, out, around, counts = _plain(text), [], [], Counter()
    for m in _RUST_ITEM.finditer(plain):
        while around and m.start() >= around[-1][1]:
            around.pop()
        word, name = m[1], " ".join(m[2].split())
        above = around[-1] if around else None
        if word == "impl":
            counts[above and above[0], name] += 1
            name = f"impl {name}[{counts[above and above[0], name]}]"
        symbol = f"{above[0]}::{name}" if above else name
        kind = _RUST_KIND.get(word, word) if word != "fn" else "method" if above and above[3] in ("impl", "trait") else "function"
        end = _block_end(plain, m.start())
        body = text[m.start():end if end >= 0 else len(text)]
        out.append((len(out), symbol, kind, above[2] if above else None, text.count("\n", 0, m.start()) + 1, body.split("\n", 1)[0].strip(), structure_hash(body), end < 0))
        if word != "fn":
            around.append((symbol, end if end >= 0 else len(text), len(out) - 1, kind))
    return out


#: Calls that make a value of a built-in type.
BUILTIN_MAKERS = ["bool", "dict", "float", "frozenset", "int", "list", "set", "str", "tuple"]


def _dotted(node: ast.expr) -> str | None:
    """Name of what is called, dots included."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return None


def _wrapped(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str | None:
    """What a function delegates to, if it does nothing but hand its arguments on as they are."""
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    if len(body) != 1 or not isinstance(body[0], ast.Return) or not isinstance(body[0].value, ast.Call):
        return None
    call, names = body[0].value, [a.arg for a in node.args.args]
    own = names[1:] if names[:1] in (["self"], ["cls"]) else names
    handed = [a.id if isinstance(a, ast.Name) else None for a in call.args]
    target = _dotted(call.func)
    return target if own and not call.keywords and handed == own and target not in BUILTIN_MAKERS else None


_FACTS = {"symbol": "string", "calls": "array<string>", "strings": "array<string>", "returns": "array<string>", "raises": "array<string>", "mutations": "array<string>", "decorators": "array<string>",
          "roots": "array<string>", "reads": "array<string>", "writes": "array<string>", "wrapper_target": "string"}


def _own_attribute(node: ast.expr) -> str | None:
    return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in ("self", "cls") else None


def _function_facts(node: ast.FunctionDef | ast.AsyncFunctionDef, symbol: str) -> tuple:
    calls, strings, returns, raises, changes, reads, writes, roots = [], [], [], [], [], set(), [], set()
    arguments = {a.arg for a in node.args.args} & {"self", "cls"}
    for part in (n for statement in node.body for n in ast.walk(statement)):
        if isinstance(part, ast.Call) and (name := _dotted(part.func)):
            calls.append((part.lineno, part.col_offset, name))
        elif isinstance(part, ast.Constant) and isinstance(part.value, str):
            strings.append(part.value)
        elif isinstance(part, ast.Return) and part.value is not None:
            returns.append(ast.unparse(part.value))
        elif isinstance(part, ast.Raise) and part.exc is not None:
            raises.append(_dotted(part.exc.func if isinstance(part.exc, ast.Call) else part.exc) or "")
        elif isinstance(part, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and part.value is not None:
            for target in part.targets if isinstance(part, ast.Assign) else [part.target]:
                if isinstance(target, (ast.Attribute, ast.Subscript)):
                    changes.append(ast.unparse(target))
                if own := _own_attribute(target):
                    writes.append(f"{own}<-{ast.unparse(part.value)}")
        if isinstance(part, ast.Attribute) and isinstance(part.ctx, ast.Load) and (own := _own_attribute(part)):
            reads.add(own)
        if isinstance(part, ast.Name) and isinstance(part.ctx, ast.Load) and part.id not in arguments:
            roots.add(part.id)
    names = [n for _, _, n in sorted(calls)]
    return symbol, names, strings, returns, raises, changes, [ast.unparse(d) for d in node.decorator_list], sorted(roots), sorted(reads), writes, _wrapped(node)


def _facts_of(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def visit(body: list[ast.stmt], names: list[str]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(_function_facts(node, ".".join([*names, node.name])))
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(node.body, [*names, node.name])

    visit(tree.body, [])
    return out


def _rows(df: DataFrame, key: str, text: str, fields: dict[str, str], make: Callable[[str], list[tuple]]) -> DataFrame:
    types = [pa.string() if t == "string" else pa.list_(pa.string()) for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = make(t) if t is not None else []
                at += [i] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[key, *fields])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def python_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per function of a Python source: what it calls (in order), holds, returns, raises, changes, the names it starts from, attributes it reads and writes, and what it merely wraps."""
    return _rows(df, key, text, _FACTS, _facts_of)


def _module_of(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    imports, called, aliases = set(), set(), {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                imports.add(a.name)
                aliases[a.asname or a.name.split(".")[0]] = a.name
        elif isinstance(node, ast.ImportFrom):
            imports.add(node.module or "")
            for a in node.names:
                if a.name != "*":
                    aliases[a.asname or a.name] = f"{node.module}.{a.name}" if node.module else a.name
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
            called.add(name)
    return [(sorted(imports - {""}), sorted(called), [f"{k}={v}" for k, v in sorted(aliases.items())])]


def module_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per Python source: imports, called names and aliases (`local=full`), each sorted."""
    return _rows(df, key, text, {"imports": "array<string>", "called": "array<string>", "aliases": "array<string>"}, _module_of)


def units(df: DataFrame, key: str, text: str, extract: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows of an extractor over a table of texts; null texts have none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = extract(t) if t is not None else []
                at += [i] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def rescued(declared: DataFrame, found: DataFrame, known: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Declared units that a filtered scan left out but the whole index has, of exactly the declared kind."""
    lost = declared.join(found.select(*keys), keys, "left_anti")
    return lost.join(known.select(*keys, kind).distinct(), [*keys, kind], "left_semi")


def summary(df: DataFrame) -> DataFrame:
    """Units and broken texts by kind."""
    return df.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("error").alias("n_broken"))
