"""SARIF files of any size, read as pieces between braces and walked token by token, so that neither a file nor a run has to fit a cell.

Spark's text reader cuts files at every `}`, by blocks. One task walks a file's pieces in their order: it holds what the document's nesting needs and the one
result (or tool) that it's in, and yields results as they end. Documents that can't be used are known at their end only; what they've yielded is left out then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.text import decoded
from leadmill.functions.variants import list_at, text_at
from leadmill.operators.leads import normalized_tool

_TOKEN = re.compile(r'[ \t\n\r]+|[{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|[^ \t\n\r{}\[\],:"]+')
_PLAIN = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
NOT_JSON, NO_RUNS, OTHER = "malformed SARIF: not JSON", "malformed SARIF: missing runs[]", "unsupported SARIF version"


class Walk:
    """One document. `feed` its text in pieces and `close` it: each gives (kind, run, pos, text), kind being result, tool or bases; `error` says what `close` found.

    Where a key comes twice in an object, the first `runs` and the last of the others count.
    """

    def __init__(self, version: str = "2.1.0"):
        self.version, self.error = version, None
        self.stack: list[list] = []  # of each open object or array: its bracket, its present key or index
        self.want = "value"  # or key, first key, colon, next, end, or value that may be the array's end
        self.rest, self.taken = "", None  # text that isn't a whole token yet; the tokens of the value that is being taken, its depth and its name
        self.runs = self.found_version = None

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[str, int, int, str]]:
        text, at = self.rest + text, 0
        while at < len(text) and not self.error:
            m = _TOKEN.match(text, at)
            if not m or m.end() == len(text) and not last and text[at] not in "{}[],:":
                if not m and (text[at] != '"' or last or _broken(text, at)):
                    self.error = NOT_JSON
                break
            at = m.end()
            if not m[0][0].isspace():
                yield from self._token(m[0])
            elif self.taken:
                self.taken[0].append(m[0])
        self.rest = text[at:]

    def close(self) -> Iterator[tuple[str, int, int, str]]:
        yield from self.feed("", last=True)
        if not self.error:
            self.error = NOT_JSON if self.want != "end" or self.rest else NO_RUNS if self.runs != "[" else OTHER if self.found_version != f'"{self.version}"' else None

    def _token(self, t: str) -> Iterator[tuple[str, int, int, str]]:
        want, c = self.want, t[0]
        if want in ("key", "first key") and c == '"':
            self.stack[-1][1], self.want = t, "colon"
        elif want == "colon" and t == ":":
            self.want = "value"
        elif want == "next" and t == ",":
            self.want = "key" if self.stack[-1][0] == "{" else "value"
            if self.stack[-1][0] == "[":
                self.stack[-1][1] += 1
        elif c in "}]" and self.stack and self.stack[-1][0] == {"}": "{", "]": "["}[c] and want in ("next", "first key" if c == "}" else "first"):
            self.stack.pop()
            self.want = "next" if self.stack else "end"
        elif want in ("value", "first") and (c in '{["' or _PLAIN.fullmatch(t)):
            self._begin(t)
            if c in "{[":
                self.stack.append([c, 0])
                self.want = "first key" if c == "{" else "first"
            else:
                self.want = "next" if self.stack else "end"
        else:
            self.error = NOT_JSON
            return
        if self.taken:
            tokens, depth, name = self.taken
            tokens.append(t)
            if len(self.stack) == depth and self.want in ("next", "end"):
                self.taken = None
                yield (*name, "".join(tokens))

    def _begin(self, t: str) -> None:
        """A value begins: is it one to take?"""
        where = [x[1] for x in self.stack]
        if where == ['"version"']:
            self.found_version = t
        elif where == ['"runs"'] and self.runs is None:
            self.runs = t
        if self.taken or self.runs != "[" or len(where) < 3 or where[0] != '"runs"' or self.stack[1][0] != "[" or self.stack[2][0] != "{":
            return
        if len(where) == 3 and where[2] in ('"tool"', '"originalUriBaseIds"'):
            self.taken = ([], 3, ("tool" if where[2] == '"tool"' else "bases", where[1], 0))
        elif len(where) == 4 and where[2] == '"results"' and self.stack[3][0] == "[":
            self.taken = ([], 4, ("result", where[1], where[3]))


def _broken(text: str, at: int) -> bool:
    """The string that begins there is bad already, not only unfinished."""
    return not re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*(?:\\(?:u[0-9a-fA-F]{0,3})?)?\Z').match(text, at)


def read_pieces(spark: SparkSession, path: str, run_id: Column | None = None) -> DataFrame:
    """run_id, doc, kind, run, pos, text of SARIF files: results, tools and base ids as JSON texts, and a row of kind `end` with the document's error, if it has one, as text."""
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2) if run_id is None else run_id
    own = [F.col("_metadata.file_path").alias("file"), folder.alias("run_id"), F.col("_metadata.file_name").alias("doc"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.option("lineSep", "}").text(path).select(*own, F.monotonically_increasing_id().alias("at"), F.octet_length("value").alias("size"), decoded(F.col("value")).alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "block", "at").drop("block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, out = None, None, []
        read = total = 0

        def ended() -> None:
            # The last piece has a brace behind it if the sizes of all pieces and the braces between them leave one byte of the file.
            out.extend(walk.feed("}") if total - read == 1 else ())
            out.extend(walk.close())
            out.append(("end", None, None, walk.error))

        def batch() -> pa.RecordBatch:
            kind, number, pos, text = zip(*out, strict=True)
            n = len(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * n, pa.string()), pa.array([now[2]] * n, pa.string()), pa.array(kind), pa.array(number, pa.int32()), pa.array(pos, pa.int32()), pa.array(text, pa.string())], ["run_id", "doc", "kind", "run", "pos", "text"])

        for b in batches:
            for *own_, size, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if own_ != now:
                    if walk:
                        ended()
                        yield batch()
                    now, walk, read, total = own_, Walk(), 0, own_[3]
                else:
                    out.extend(walk.feed("}"))
                    read += 1
                read += size
                out.extend(walk.feed(value))
                if len(out) >= 256:
                    yield batch()
        if walk:
            ended()
            yield batch()

    return rows.select("file", "run_id", "doc", "bytes", "size", "value").mapInArrow(run, "run_id string, doc string, kind string, run int, pos int, text string")


def piece_errors(pieces: DataFrame) -> DataFrame:
    """run_id, doc, error of documents that can't be used."""
    return pieces.where("kind = 'end' and text is not null").select("run_id", "doc", F.col("text").alias("error"))


def exploded_pieces(pieces: DataFrame) -> DataFrame:
    """The rows of leads.exploded, from pieces, which are read three times: settle them before."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    runs = pieces.where("kind in ('tool', 'bases')").groupBy("run_id", "doc", "run").agg(F.try_parse_json(of("tool")).alias("t"), F.try_parse_json(of("bases")).alias("b"))
    rows = pieces.where("kind = 'result'").join(piece_errors(pieces), ["run_id", "doc"], "left_anti").join(runs, ["run_id", "doc", "run"], "left")
    tool, rules, bases = normalized_tool(text_at(F.col("t"), "$.driver.name")), list_at(F.col("t"), "$.driver.rules"), F.try_variant_get("b", "$", "map<string,variant>")
    return rows.select("run_id", "doc", "run", tool.alias("tool"), rules.alias("rules"), bases.alias("bases"), "pos", F.try_parse_json("text").alias("result"))
