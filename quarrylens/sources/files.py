"""Readers: changelogs, properties, YAML, POMs, statistics, checkpoints; each gives a DataFrame with a stated schema."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from posixpath import dirname, join, normpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "seq long, kind string, table_name string, object_name string, column_csv string, is_unique boolean"
CHECKPOINT = "sessionId string, startTime string, lastUpdateTime string, processed array<string>, suggestedIndexes array<string>, modifiedFiles array<string>"
STATS = "date string, repository string, queries_analyzed int, annotations_changed int, positions_changed int, indexes_created int, indexes_dropped int"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _true(element, name: str) -> bool:
    return (element.get(name) or "").lower() == "true"


def changes_of(xml: str) -> list[tuple]:
    """(kind, table, object, column csv, unique) of a changelog's changes in order; an include is kind include with its file as object."""
    out: list[tuple] = []

    def columns(e) -> str:
        names = [c.get("name") or "" for c in e if _local(c.tag) == "column"]
        return ",".join(n.strip() for n in names if n.strip())

    def csv(text: str | None) -> str:
        return ",".join(c.strip() for c in (text or "").split(",") if c.strip())

    def change(e) -> None:
        kind, table = _local(e.tag), e.get("tableName")
        if kind == "includeAll":
            out.append((kind, e.get("relativeToChangelogFile"), e.get("path"), None, False))
        elif kind == "include":
            out.append(("include", e.get("relativeToChangelogFile"), e.get("file"), None, False))
        elif kind == "changeSet":
            for c in e:
                change(c)
        elif kind == "createIndex":
            out.append((kind, table, e.get("indexName"), columns(e), _true(e, "unique")))
        elif kind in ("addPrimaryKey", "addUniqueConstraint"):
            out.append((kind, table, e.get("constraintName"), csv(e.get("columnNames")), False))
        elif kind in ("createTable", "addColumn"):
            keys = []
            for c in e:
                for k in c:
                    if _local(k.tag) == "constraints" and _local(c.tag) == "column":
                        if _true(k, "unique"):
                            out.append((kind + "Unique", table, k.get("uniqueConstraintName"), c.get("name"), True))
                        if _true(k, "primaryKey"):
                            keys.append((c.get("name"), k.get("primaryKeyName")))
            if keys and kind == "createTable":
                out.append((kind, table, keys[0][1], ",".join(k for k, _ in keys), False))
            elif keys:
                out.extend(("addColumnKey", table, n, c, False) for c, n in keys)
        elif kind == "dropIndex":
            out.append((kind, table, e.get("indexName"), None, False))
        elif kind in ("dropPrimaryKey", "dropUniqueConstraint"):
            out.append((kind, table, e.get("constraintName"), None, False))
        elif kind == "addForeignKeyConstraint":
            out.append(("addForeignKey", e.get("baseTableName"), e.get("constraintName"), ">".join((csv(e.get("baseColumnNames")), e.get("referencedTableName") or "", csv(e.get("referencedColumnNames")))), False))
        elif kind == "sql":
            out.append(("sql", None, e.text or "", None, False))

    for e in ET.fromstring(xml):
        change(e)
    return out


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """All changes of a changelog and its includes, in order; raw SQL as kind ``sql`` with its text as object_name. Changelogs are small, their order is not.

    A file that includes itself raises ValueError; includeAll takes a folder's .xml files by name.
    """

    def below(at: str, relative: str | None, name: str) -> str:
        if (relative or "").lower() != "true" and "/resources/" in at:
            return at.split("/resources/")[0] + "/resources/" + name.removeprefix("classpath:").lstrip("/")
        return normpath(join(dirname(at), name)) if "://" not in at else at[: at.index("://") + 3] + normpath(join(dirname(at[at.index("://") + 3 :]), name))

    def load(at: str, seen: tuple) -> list[tuple]:
        out = []
        for kind, table, name, csv, unique in changes_of(spark.read.text(at, wholetext=True).first()[0]):
            if kind in ("include", "includeAll"):
                inner = below(at, table, name)
                for file in [inner] if kind == "include" else listed(spark, inner, ".xml"):
                    if file in seen:
                        raise ValueError(f"{file} includes itself")
                    out += load(file, (*seen, file))
            else:
                out.append((kind, table, name, csv, unique))
        return out

    return spark.createDataFrame([(i, *c) for i, c in enumerate(load(path, (path,)))], CHANGE)


def listed(spark: SparkSession, folder: str, end: str) -> list[str]:
    """Files right in a folder whose names have that end, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.isFile()]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(end)]


def resource_root(path):
    """Directory that changelog paths are relative to: main resources, else test resources, else the parent."""
    found = F.regexp_extract(path, r"^(.*?/src/(?:main|test)/resources)(?:/|$)", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def relative_path(path, root):
    return F.ltrim(F.substr(path, F.length(root) + 1), F.lit("/"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, key, value): comments and blank lines left out, = or : between, backslash at the end continues."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\\\r?\n\s*", "").alias("value"))
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).filter(~F.col("line").rlike(r"^\s*([#!]|$)"))
    return lines.select("file", "line_no", F.regexp_extract("line", r"^\s*([^=:\s]+)", 1).alias("key"), F.trim(F.regexp_extract("line", r"^\s*[^=:\s]+\s*[=:\s]\s*(.*)$", 1)).alias("value"))


_BLOCK = re.compile(r"^([|>])(?:([+-])?([1-9])?|([1-9])([+-]))$")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[{&*!|>%@`#-][^\n]*?|-[^\s][^\n]*?)\s*:(?:\s+(.*))?$""")


def _uncommented(line: str) -> str:
    """A line without its comment; a # in quotes, or inside a word, is none."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[k - 1] == "\\") else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " \t[{,:-("):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def _unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    return "" if text in ("~", "null") else text


def _flow(text: str, key: str) -> list[tuple[str, str]]:
    """Dotted keys of a flow map or list; what isn't closed is read as far as it goes."""
    out, stack, token, name, quote = [], [], "", None, ""

    def end() -> None:
        nonlocal token, name
        kind, base, n = stack[-1]
        if kind == "[" and token.strip():
            out.append((f"{base}[{n}]", _unquoted(token)))
        elif kind == "{" and (name is not None or token.strip()):
            out.append((f"{base}.{name}".lstrip(".") if name is not None else f"{base}.{_unquoted(token)}".lstrip("."), _unquoted(token) if name is not None else ""))
        token, name = "", None

    for k, c in enumerate(text):
        if quote:
            token += c
            quote = "" if c == quote and not (quote == '"' and text[k - 1] == "\\") else quote
        elif c in "\"'" and not token.strip():
            quote, token = c, token + c
        elif c in "[{":
            if stack:
                kind, base, n = stack[-1]
                key = f"{base}[{n}]" if kind == "[" else f"{base}.{name}".lstrip(".")
            stack.append([c, key, 0])
            token, name = "", None
        elif stack and c in "]},":
            closed = token == "" and name is None and k and text[:k].rstrip()[-1:] in ("]", "}")
            if not closed:
                end()
            if c == ",":
                stack[-1][2] += 1
            else:
                stack.pop()
            token, name = "", None
        elif stack and c == ":" and stack[-1][0] == "{" and name is None and text[k + 1 : k + 2] in (" ", "", "\t", '"', "'", "[", "{"):
            name, token = _unquoted(token), ""
        else:
            token += c
    return out


def _folded(lines: list[str], style: str, chomp: str) -> str:
    """A block scalar's text: literal lines, or folded ones; one line end, none or all at its end."""
    body = list(lines)
    ends = 0
    while body and not body[-1].strip():
        body.pop()
        ends += 1
    if style == "|":
        text = "\n".join(body)
    else:
        text = ""
        for k, line in enumerate(body):
            blank, before = not line.strip(), body[k - 1].strip() if k else ""
            text += "\n" if blank else (" " if before and not line.startswith(" ") else "") + line
    return text + {"-": "", "+": "\n" * (ends + bool(body))}.get(chomp, "\n" if body else "")


def flat_yaml(text: str) -> list[tuple[str, str]]:
    """Dotted keys of YAML: nested maps, lists by index, flow maps and lists, block scalars, quotes; several documents in a row.

    Scalars are given as text, null as empty text; anchors and tags stay as they are written.
    """
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    lines, at = text.expandtabs(2).splitlines(), 0
    plain: tuple[int, int] | None = None  # place in out and indent of a plain scalar that may go on

    def whole(value: str, indent: int) -> str:
        """A flow value or quoted scalar with the lines that it goes on over."""
        nonlocal at
        while at < len(lines):
            quoted = value[0] in "\"'" and not re.fullmatch(r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'""", value)
            bare = re.sub(r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'""", "", value)
            if not quoted and not (value[0] in "[{" and sum(bare.count(c) for c in "[{") > sum(bare.count(c) for c in "]}")):
                break
            value = f"{value} {_uncommented(lines[at]).strip()}"
            at += 1
        return value

    while at < len(lines):
        line = _uncommented(lines[at])
        at += 1
        body, indent = line.strip(), len(line) - len(line.lstrip())
        if not body or body in ("---", "..."):
            if body == "---":
                path, counts = [], {}
            plain = None if body else plain
            continue
        key = _KEY.match(body)
        if plain and indent > plain[1] and not key and not body.startswith("- "):
            out[plain[0]] = out[plain[0]][0], f"{out[plain[0]][1]} {body}".strip()
            continue
        plain = None
        while path and path[-1][0] >= indent and not ((body.startswith("- ") or body == "-") and path[-1][0] == indent and not path[-1][1].startswith("[")):
            path.pop()
        while body.startswith("- ") or body == "-":
            base = ".".join(p for _, p in path).replace(".[", "[")
            n = counts[base] = counts.get(base, -1) + 1
            path.append((indent, f"[{n}]"))
            rest = body[1:].lstrip()
            indent, body = indent + (len(body) - len(rest) if rest else 2), rest
            key = _KEY.match(body)
        names, value = [p for _, p in path], body
        if key:
            names, value = [*names, _unquoted(key[1])], (key[2] or "").strip()
            if not value:
                path.append((indent, names[-1]))
        if not value:
            continue
        name = ".".join(names).replace(".[", "[")
        if block := _BLOCK.match(value):
            inner = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                inner.append(lines[at])
                at += 1
            first = next((x for x in inner if x.strip()), "")
            depth = indent + int(block[3] or block[4]) if block[3] or block[4] else len(first) - len(first.lstrip())
            out.append((name, _folded([x[depth:] for x in inner], block[1], block[2] or block[5] or "")))
        elif value[0] in "[{":
            out += _flow(whole(value, indent), name)
        elif value[0] in "\"'":
            out.append((name, _unquoted(whole(value, indent))))
        else:
            out.append((name, _unquoted(value)))
            plain = len(out) - 1, indent
    return out


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, key, value) with dotted keys; line_no is the order."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(f, i, k, v) for f, t in zip(pdf["file"], pdf["value"], strict=True) for i, (k, v) in enumerate(flat_yaml(t))], columns=["file", "line_no", "key", "value"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, "file string, line_no int, key string, value string")


def pom_of(xml: str) -> dict:
    """Coordinates, parent, properties, dependencies, managed dependencies, plugins and profiles of a POM."""
    root = ET.fromstring(xml)

    def child(e, name):
        return next((c for c in (e if e is not None else ()) if _local(c.tag) == name), None)

    def text(e, name):
        c = child(e, name)
        return (c.text or "").strip() if c is not None else ""

    def listed(e, group, item):
        return [(f"{text(d, 'groupId')}:{text(d, 'artifactId')}", text(d, "version")) for d in (child(e, group) if child(e, group) is not None else ()) if _local(d.tag) == item]

    parent, build = child(root, "parent"), child(root, "build")
    return {
        "ga": f"{text(root, 'groupId') or text(parent, 'groupId')}:{text(root, 'artifactId')}",
        "version": text(root, "version") or text(parent, "version"),
        "parent": f"{text(parent, 'groupId')}:{text(parent, 'artifactId')}" if parent is not None else None,
        "parent_version": text(parent, "version") if parent is not None else None,
        "relative_path": (text(parent, "relativePath") or "../pom.xml") if parent is not None else None,
        "properties": [(_local(c.tag), (c.text or "").strip()) for c in (child(root, "properties") if child(root, "properties") is not None else ())],
        "dependencies": listed(root, "dependencies", "dependency"),
        "managed": listed(child(root, "dependencyManagement"), "dependencies", "dependency"),
        "plugins": listed(build, "plugins", "plugin"),
        "profiles": [(text(p, "id"), "") for p in (child(root, "profiles") if child(root, "profiles") is not None else ())],
    }


def pom_layers(spark: SparkSession, path: str, repository: str | None = None) -> DataFrame:
    """layers(file, level, kind, key, value, seq) of a POM and its parents, level 0 the root-most; a chain is short.

    A parent is looked for by its relative path, then in ``repository`` (a local repository's folder) by its coordinates. One that is not
    there ends the chain; one that leads back into it raises ValueError.
    """
    chain, at, seen = [], path, {path}
    while at is not None:
        pom = pom_of(spark.read.text(at, wholetext=True).first()[0])
        chain.append(pom)
        ways = [normpath(join(dirname(at), pom["relative_path"]))] if pom["relative_path"] and "://" not in at else []
        if "://" in at and pom["relative_path"]:
            head = at[: at.index("://") + 3]
            ways = [head + normpath(join(dirname(at.removeprefix(head)), pom["relative_path"]))]
        if pom["parent"] and repository:
            group, artifact = pom["parent"].split(":")
            ways.append(f"{repository}/{group.replace('.', '/')}/{artifact}/{pom['parent_version']}/{artifact}-{pom['parent_version']}.pom")
        at = next((w for w in ways if _exists(spark, w)), None)
        if at in seen:
            raise ValueError(f"{at} is its own parent")
        seen.add(at)
    rows = [(path, level, kind, k, v, i) for level, pom in enumerate(reversed(chain)) for kind in ("properties", "dependencies", "managed", "plugins", "profiles") for i, (k, v) in enumerate(pom[kind])]
    return spark.createDataFrame(rows, "file string, level int, kind string, key string, value string, seq long")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=STATS)


def processed_repositories(stats: DataFrame) -> DataFrame:
    """Repositories that a statistics file has, once each."""
    return stats.select(F.trim("repository").alias("name")).filter("name <> ''").distinct()


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A saved run; a corrupt or missing file gives no rows, a fresh start. Unknown keys are ignored."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CHECKPOINT)
    return spark.read.json(path, schema=CHECKPOINT, mode="PERMISSIVE", multiLine=True).filter("sessionId IS NOT NULL")


def store_options(settings: dict) -> dict:
    """Options of the graph store: type age or the default, edges a batch, whether to clear first."""
    kind = str(settings.get("type", "neo4j")).lower()
    return {"type": "age" if kind == "age" else "neo4j", "batch_size": int(settings.get("batch_size", 1000)), "mode": "overwrite" if str(settings.get("clear_on_start", False)).lower() == "true" else "append"}
