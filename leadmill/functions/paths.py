"""Expressions on paths and URIs. Paths use `/`; nothing here touches a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that bulk scans leave out, and marks of generated files.
EXCLUDED = ("vendor", "node_modules", "dist", "build", "out", "target", "bin", "obj")
GENERATED = r"(\.min\.(js|css)|\.map|\.generated\.[^/.]+|\.designer\.cs|_pb2\.py|\.pb\.go)$"
#: Files and extensions that show a stack.
MANIFESTS = {
    "php": (("composer.json",), ("php",)),
    "node": (("package.json",), ("js", "ts", "mjs", "cjs")),
    "python": (("pyproject.toml", "requirements.txt"), ("py",)),
    "java": (("pom.xml", "build.gradle"), ("java", "kt")),
    "dotnet": ((), ("cs", "csproj")),
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def excluded(path: Column) -> Column:
    """The file lies in a vendored or built folder, or is generated."""
    folders = F.split(path, "/")
    return F.exists(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), lambda s: s.isin(*EXCLUDED)) | path.rlike(GENERATED)


def stacks(path: Column) -> Column:
    """The stacks that a file's name shows."""
    name = basename(path)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    found = [F.when(name.isin(*files) if files else F.lit(False), stack).when(extension.isin(*extensions), stack) for stack, (files, extensions) in MANIFESTS.items()]
    return F.array_compact(F.array(*found))


def folded(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts; `..` at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def inside(path: Column, root: Column) -> Column:
    """The folded path is the root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(F.when(root == "/", "").otherwise(root), F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    return F.when(path == root, "").otherwise(F.substr(path, F.char_length(F.when(root == "/", "").otherwise(root)) + F.lit(2)))


def decoded(text: Column) -> Column:
    """Percent-decoded; `+` stays, and null where an escape is bad."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def resolved_uri(uri: Column, base_uri: Column, root: Column) -> Column:
    """The folded absolute path of an artifact's uri, or null for a bad one.

    A scheme other than file, a remote authority and bad percent escapes are bad. A relative uri starts from the base's uri,
    if there's one, else from the root; a relative base starts from the root, and one that can't be decoded is taken as it is.
    """
    scheme = F.lower(F.regexp_extract(uri, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_extract(uri, r"^(?i)file://([^/]*)/", 1))
    from_file = F.when(authority.isin("", "localhost") & F.startswith(F.regexp_replace(uri, r"^(?i)file:(//[^/]*)?", ""), F.lit("/")), decoded(F.regexp_replace(uri, r"^(?i)file:(//[^/]*)?", "")))
    path = F.when(uri.isNull() | (uri == ""), None).when(scheme == "file", from_file).when(scheme != "", None).otherwise(decoded(uri))
    base = F.coalesce(decoded(F.regexp_replace(base_uri, r"^file://[^/]*", "")), base_uri)
    start = F.when(base.isNull(), root).when(F.startswith(base, F.lit("/")), base).otherwise(F.concat(root, F.lit("/"), base))
    return F.when(path.isNotNull(), folded(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(start, F.lit("/"), path))))
