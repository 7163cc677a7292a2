"""Java source to graph rows: a tokenizer and a scan of declarations and bodies, run on Arrow batches of whole files.

It reads structure, not types: packages, imports, types with members and parameters, and in bodies calls, field reads, method
references, lambdas, object creations and the types named. Receivers are resolved by locals, parameters, fields, imports and the file's own
types, else the edge says ``resolution=partial``. A file that can't be read gives the rows up to there.

Rows: (kind node|edge, a, b, c, d, attributes): nodes as (signature, type, name, fqn), edges as (source, type, target, null).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|\s+|"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|@interface\b|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|\.\.\.|.', re.DOTALL)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_TYPE_WORDS = frozenset("class interface enum record @interface".split())
_PRIMITIVE = frozenset("void int long short byte char boolean float double var".split())
_NO_CALL = frozenset("if for while switch catch return new synchronized try else do throw assert super this instanceof case yield".split())
NODE_TYPE = {"class": "Class", "record": "Class", "interface": "Interface", "@interface": "Interface", "enum": "Enum"}


@dataclass
class _Token:
    text: str
    line: int
    column: int


@dataclass
class Scan:
    package: str = ""
    imports: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)


def tokens(source: str) -> list[_Token]:
    out, line, start = [], 1, 0
    for m in _TOKEN.finditer(source):
        t = m[0]
        if not t.isspace() and not t.startswith(("//", "/*")):
            out.append(_Token(t, line, m.start() - start + 1))
        if n := t.count("\n"):
            line, start = line + n, m.start() + t.rindex("\n") + 1
    return out


class _Reader:
    def __init__(self, source: str):
        self.t = tokens(source)
        self.i = 0
        self.out = Scan()

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1].text if self.i <= len(self.t) else ""

    def close(self, k: int) -> int:
        """Place after the bracket that ends the one at ``k``."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
        a, b = self.t[k].text, pairs[self.t[k].text]
        for j in range(k, len(self.t)):
            depth += (self.t[j].text == a) - (self.t[j].text == b)
            if depth == 0:
                return j + 1
        return len(self.t)

    def text(self, a: int, b: int) -> str:
        """Source of tokens a to b: no spaces but between words."""
        out = ""
        for t in self.t[a:b]:
            out += (" " if out and (out[-1].isalnum() or out[-1] in "_$") and (t.text[0].isalnum() or t.text[0] in "_$") else "") + t.text
        return out

    def node(self, signature: str, kind: str, name: str, fqn: str) -> None:
        self.out.rows.append(("node", signature, kind, name, fqn, None))

    def edge(self, source: str, type_: str, target: str, **attributes: str) -> None:
        self.out.rows.append(("edge", source, type_, target, None, attributes))

    def resolve(self, name: str) -> str | None:
        """Full name of a type written in the file, or None."""
        base = re.sub(r"<.*>|\[\]|\.\.\.", "", name)
        head, _, rest = base.partition(".")
        found = self.out.types.get(head) or self.out.imports.get(head)
        return (f"{found}.{rest}" if rest else found) if found else base if "." in base and base[0].islower() else None

    def file(self) -> Scan:
        for k, t in enumerate(self.t):  # own types first, so uses before them resolve
            if t.text in _TYPE_WORDS and k + 1 < len(self.t) and re.match(r"[A-Z]", self.t[k + 1].text) and (k == 0 or self.t[k - 1].text != "."):
                self.out.types.setdefault(self.t[k + 1].text, "")
        while self.i < len(self.t):
            if self.peek() == "package":
                end = next(j for j in range(self.i, len(self.t)) if self.t[j].text == ";")
                self.out.package, self.i = self.text(self.i + 1, end), end + 1
                self.out.types = {n: f"{self.out.package}.{n}" for n in self.out.types}
            elif self.peek() == "import":
                end = next(j for j in range(self.i, len(self.t)) if self.t[j].text == ";")
                name = self.text(self.i + 1 + (self.peek(1) == "static"), end)
                self.out.imports[name.rpartition(".")[2]] = name
                self.i = end + 1
            elif self.peek() == "@" or self.peek() in _MODIFIERS or self.peek() in _TYPE_WORDS:
                self.declaration("", None)
            else:
                self.i += 1
        self.out.types = {n: f or n for n, f in self.out.types.items()}
        return self.out

    def annotations(self) -> list[str]:
        """Names of the annotations here; modifiers are stepped over."""
        found = []
        while self.peek() == "@" or self.peek() in _MODIFIERS or self.peek() == "non":
            if self.take() == "@":
                name = self.take()
                while self.peek() == ".":
                    name += self.take() + self.take()
                found.append(name)
                if self.peek() == "(":
                    self.i = self.close(self.i)
        return found

    def annotate(self, source: str, names: list[str]) -> None:
        for name in names:
            fqn = self.resolve(name) or (name if "." in name else f"unresolved:{source}:{name}")
            self.node(f"annotation:{fqn}", "Annotation", name, fqn)
            self.edge(source, "ANNOTATED_BY", f"annotation:{fqn}")

    def generic(self) -> None:
        depth = 0
        while self.i < len(self.t):
            depth += (self.peek() == "<") - (self.peek() == ">")
            self.i += 1
            if depth == 0:
                return

    def type_text(self) -> str:
        a = self.i
        while self.peek() == "@":
            self.annotations()
        self.i += 1
        while self.peek() in ("<", ".", "["):
            if self.peek() == "<":
                self.generic()
            elif self.peek() == ".":
                self.i += 2
            elif self.peek(1) == "]":
                self.i += 2
            else:
                break
        if self.peek() == "...":
            self.i += 1
        return self.text(a, self.i)

    def declaration(self, owner: str, fields: dict | None) -> None:
        marks = self.annotations()
        if self.peek() in _TYPE_WORDS and re.match(r"[A-Za-z_]", self.peek(1)):
            self.type_declaration(owner, marks)
        elif owner:
            self.member(owner, marks, fields if fields is not None else {})
        else:
            self.i += 1

    def type_declaration(self, owner: str, marks: list[str]) -> None:
        kind, name = self.take(), self.take()
        signature = f"{owner or self.out.package}.{name}".lstrip(".")
        self.out.types[name] = signature
        self.node(signature, NODE_TYPE[kind], name, signature)
        if owner:
            self.edge(owner, "CONTAINS", signature)
            self.edge(owner, "ENCLOSES", signature, kind="inner_class")
        self.annotate(signature, marks)
        fields: dict[str, str] = {}
        if self.peek() == "<":
            self.generic()
        if self.peek() == "(":
            self.i = self.close(self.i)
        while self.peek() in ("extends", "implements", "permits"):
            word = self.take()
            while True:
                base = self.type_text()
                if word != "permits":
                    self.edge(signature, "IMPLEMENTS" if word == "implements" else "EXTENDS", self.resolve(base) or base)
                if self.peek() != ",":
                    break
                self.i += 1
        if self.peek() != "{":
            return
        end = self.close(self.i)
        self.i += 1
        if kind == "enum":
            self.constants(signature, end)
        held = self.i
        self.fields_ahead(end, fields)
        self.i, initializers = held, 0
        while self.i < end - 1:
            if self.peek() == ";":
                self.i += 1
            elif self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
                self.i += self.peek() == "static"
                block = f"{signature}#<clinit>" + (f"_{initializers}" if initializers else "")
                initializers += 1
                self.node(block, "StaticBlock", "<clinit>", signature)
                self.edge(signature, "CONTAINS", block)
                stop = self.close(self.i)
                self.body(block, signature, self.i + 1, stop - 1, dict(fields))
                self.i = stop
            else:
                before = self.i
                self.declaration(signature, fields)
                self.i = max(self.i, before + 1)
        self.i = end

    def constants(self, owner: str, end: int) -> None:
        while self.i < end - 1 and self.peek() != ";":
            self.annotations()
            name = self.take()
            if re.match(r"[A-Za-z_$]", name):
                self.node(f"{owner}#{name}", "EnumConstant", name, owner)
                self.edge(owner, "CONTAINS", f"{owner}#{name}")
            for bracket in "({":
                if self.peek() == bracket:
                    self.i = self.close(self.i)
            if self.peek() == ",":
                self.i += 1

    def fields_ahead(self, end: int, fields: dict[str, str]) -> None:
        """Types of a body's fields, which methods above them use too."""
        while self.i < end - 1:
            if self.peek() == "{":
                self.i = self.close(self.i)
            elif self.peek() == "(":
                self.i = self.close(self.i)
            elif re.match(r"[A-Za-z_$]", self.peek()) and self.peek() not in _MODIFIERS | _TYPE_WORDS and self.t[self.i - 1].text != "@":
                kind, a = self.type_text(), self.i
                if re.match(r"[A-Za-z_$]", self.peek()) and self.peek(1) in (";", "=", ","):
                    fields[self.peek()] = self.resolve(kind) or kind
                    while self.i < end - 1 and self.peek() != ";":
                        self.i = self.close(self.i) if self.peek() in ("(", "{") else self.i + 1
                self.i = max(self.i, a)
            else:
                self.i += 1

    def member(self, owner: str, marks: list[str], fields: dict[str, str]) -> None:
        if self.peek() == "<":
            self.generic()
        if self.peek(1) == "(" and self.peek() == owner.rpartition(".")[2]:
            self.callable(owner, self.take(), None, marks, fields)
            return
        kind = self.type_text()
        if self.peek(1) == "(":
            self.callable(owner, self.take(), kind, marks, fields)
            return
        while self.i < len(self.t) and re.match(r"[A-Za-z_$]", self.peek()):
            name = self.take()
            signature = f"{owner}#{name}"
            self.node(signature, "Field", name, owner)
            self.edge(owner, "CONTAINS", signature)
            self.annotate(signature, marks)
            if (target := self.resolve(kind)) is not None:
                self.edge(signature, "USES", target)
            a = self.i
            while self.i < len(self.t) and self.peek() not in (",", ";"):
                self.i = self.close(self.i) if self.peek() in ("(", "{", "[") else self.i + 1
            self.body(signature, owner, a, self.i, dict(fields))
            if self.take() != ",":
                return

    def callable(self, owner: str, name: str, returns: str | None, marks: list[str], fields: dict[str, str]) -> None:
        end = self.close(self.i)
        self.i += 1
        params: list[tuple[str, str, list[str]]] = []
        while self.i < end - 1:
            own = self.annotations()
            kind = self.type_text()
            params.append((kind, self.take(), own))
            while self.peek() in ("[", "]"):
                self.i += 1
            if self.peek() == ",":
                self.i += 1
        self.i = end
        signature = f"{owner}#{name}({','.join(k for k, _, _ in params)})"
        self.node(signature, "Constructor" if returns is None else "Method", name, owner)
        self.edge(owner, "CONTAINS", signature)
        self.annotate(signature, marks)
        for kind, p, own in params:
            if own:
                self.node(f"{signature}#{p}:{kind}", "Parameter", p, owner)
                self.edge(signature, "CONTAINS", f"{signature}#{p}:{kind}")
                self.annotate(f"{signature}#{p}:{kind}", own)
        if returns not in (None, "void") and (target := self.resolve(returns)) is not None:
            self.edge(signature, "USES", target)
        while self.i < len(self.t) and self.peek() not in ("{", ";"):
            self.i += 1
        if self.peek() == "{":
            stop = self.close(self.i)
            self.body(signature, owner, self.i + 1, stop - 1, fields | {p: self.resolve(k) or k for k, p, _ in params})
            self.i = stop
        else:
            self.i += 1

    def receiver(self, k: int) -> tuple[int, str]:
        """Start and text of the expression that ends before the dot at ``k``."""
        j = k
        while j > 0:
            t = self.t[j - 1].text
            if t in (")", "]"):
                opener, depth = {")": "(", "]": "["}[t], 0
                while j > 0:
                    j -= 1
                    depth += (self.t[j].text == t) - (self.t[j].text == opener)
                    if depth == 0:
                        break
                if j > 0 and re.match(r"[A-Za-z_$]", self.t[j - 1].text) and self.t[j - 1].text not in _NO_CALL:
                    j -= 1
            elif re.match(r"[\w$\"']", t) and t not in ("return", "throw", "case", "assert", "else", "yield"):
                j -= 1
            else:
                break
            if j > 0 and self.t[j - 1].text == "new":
                j -= 1
                break
            if not (j > 0 and self.t[j - 1].text == "."):
                break
            j -= 1
        return j, self.text(j, k)

    def type_of(self, text: str, owner: str, symbols: dict[str, str]) -> str | None:
        if text == "this":
            return owner
        if m := re.match(r"new ([\w.$]+)", text):
            return self.resolve(m[1]) or m[1]
        if m := re.match(r"\(\(([\w.$]+)\)", text):
            return self.resolve(m[1]) or m[1]
        if re.fullmatch(r"[\w$]+", text):
            return symbols.get(text) or self.resolve(text)
        if re.fullmatch(r"[\w$]+(\.[\w$]+)+", text):
            return self.type_of(text.rpartition(".")[0], owner, symbols)
        return None

    def arguments(self, k: int) -> list[str]:
        end, out, a, depth = self.close(k), [], k + 1, 0
        for j in range(k + 1, end):
            t = self.t[j].text
            if depth == 0 and t in (",", ")") and (t == "," or j == end - 1):
                if j > a:
                    out.append(self.text(a, j))
                a = j + 1
            depth += (t in "([{") - (t in ")]}") if t != ")" or j < end - 1 else 0
        return out

    def body(self, source: str, owner: str, a: int, b: int, symbols: dict[str, str]) -> None:
        ordinal, k = 0, a
        while k < b:
            t, after, before = self.t[k].text, self.t[k + 1].text if k + 1 < b else "", self.t[k - 1].text if k > a else ""
            if t == "->":
                start = self.close_back(k)
                stop = self.lambda_end(k + 1, b)
                at = self.t[start]
                name = f"{source}$lambda_L{at.line}C{at.column}_{ordinal}"
                ordinal += 1
                self.node(name, "Lambda", "lambda", owner)
                self.edge(source, "ENCLOSES", name, kind="lambda")
                self.body(name, owner, k + 1, stop, dict(symbols))
                k = stop
                continue
            if t == "::":
                j, text = self.receiver(k)
                found = self.type_of(text, owner, symbols)
                self.edge(source, "REFERENCES", f"{found or text}#{after}", **({} if found else {"resolution": "partial"}))
                k += 2
                continue
            if re.match(r"[A-Za-z_$]", t) and t not in _NO_CALL:
                if before == ".":
                    _, text = self.receiver(k - 1)
                    found = self.type_of(text, owner, symbols)
                    partial = {} if found else {"resolution": "partial"}
                    if after == "(":
                        args = self.arguments(k + 1)
                        self.edge(source, "CALLS", f"{found or text}#{t}()", **partial, **({"parameterValues": json.dumps(args)} if args else {}))
                    elif after not in ("::", ".") or text in symbols or text == "this":
                        if not (text[:1].islower() and self.resolve(f"{text}.{t}") is None and re.match(r"[A-Z]", t) and text not in symbols):
                            self.edge(source, "ACCESSES", f"{found or text}#{t}", accessType="READ", **partial)
                elif after == "(" and before != "new":
                    args = self.arguments(k + 1)
                    self.edge(source, "CALLS", f"{owner}#{t}()", **({"parameterValues": json.dumps(args)} if args else {}))
                elif re.match(r"[A-Z]", t) and (target := self.resolve(t)):
                    self.edge(source, "USES", target)
                if (re.match(r"[A-Z]", t) or t in _PRIMITIVE) and before != ".":
                    held, self.i = self.i, k
                    kind = self.type_text()
                    if self.i < b and re.match(r"[A-Za-z_$]", self.peek()) and self.peek() != "instanceof" and self.peek(1) in ("=", ";", ":", ","):
                        symbols[self.peek()] = self.resolve(kind) or kind
                    self.i = held
            k += 1

    def close_back(self, k: int) -> int:
        """First token of a lambda's parameters before the arrow at ``k``."""
        if self.t[k - 1].text != ")":
            return k - 1
        depth, j = 0, k
        while j > 0:
            j -= 1
            depth += (self.t[j].text == ")") - (self.t[j].text == "(")
            if depth == 0:
                return j
        return k - 1

    def lambda_end(self, k: int, b: int) -> int:
        if k < b and self.t[k].text == "{":
            return min(b, self.close(k))
        depth = 0
        for j in range(k, b):
            t = self.t[j].text
            if depth == 0 and t in (",", ";", ")", "]", "}"):
                return j
            depth += (t in "([{") - (t in ")]}")
        return b


def scan(source: str | None) -> Scan:
    """A file's rows; of one that can't be read to its end, or nests deeper than the interpreter's stack, those up to there."""
    r = _Reader(source or "")
    try:
        return r.file()
    except (IndexError, StopIteration, KeyError, RecursionError):
        return r.out


def read_java(spark: SparkSession, path: str) -> DataFrame:
    """(file, source) of every .java file below ``path``."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source"))


def graph_rows(files: DataFrame) -> DataFrame:
    """Node and edge writes of files(file, source), numbered within each file."""

    def run(batches):
        for pdf in batches:
            out = [(f, n, *row[:5], row[5]) for f, s in zip(pdf["file"], pdf["source"], strict=True) for n, row in enumerate(scan(s).rows)]
            yield pd.DataFrame(out, columns=["file", "n", "kind", "a", "b", "c", "d", "attributes"])

    return files.select("file", "source").dropDuplicates(["file"]).mapInPandas(run, "file string, n long, kind string, a string, b string, c string, d string, attributes map<string,string>")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Node writes (signature, node_type, name, fqn, seq)."""
    return rows.filter("kind = 'node'").select(F.col("a").alias("signature"), F.col("b").alias("node_type"), F.col("c").alias("name"), F.col("d").alias("fqn"), F.struct("file", "n").alias("seq"))


def edges_of(rows: DataFrame) -> DataFrame:
    """Edge writes (source_id, type, target_id, attributes, seq)."""
    return rows.filter("kind = 'edge'").select(F.col("a").alias("source_id"), F.col("b").alias("type"), F.col("c").alias("target_id"), "attributes", F.struct("file", "n").alias("seq"))
