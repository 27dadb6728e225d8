"""Files of a folder, told apart by their path below it (SRC2)."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cleaned copy: a file of that name, or one of the files that a copy is written to.
_COPY = r"_cleaned\.json$|(^|/)dataset=[^/]*_cleaned/[^/]*$"
#: What a URI has as it is; other ASCII characters are escaped in a file's path.
_PLAIN = "/:@!$&'()*+,;=-._~"


def _root(path: str) -> str:
    """The folder that ``path`` names: what is before a pattern, or around a single file."""
    plain = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    folder = plain.rpartition("/")[0] if plain != path or plain.endswith(".json") else plain
    bare = re.sub(r"^[A-Za-z0-9+.-]+:/*|^\./", "", folder.rstrip("/")).lstrip("/")
    return "".join(c if ord(c) > 127 else quote(c, safe=_PLAIN) for c in bare)


def below(path: str) -> Column:
    """The path of the row's file below the folder ``path``: ``a/t.json`` and ``b/t.json``
    stay two. It is written as in a URI, and whole where the folder is not found in it."""
    file, root = F.col("_metadata.file_path"), _root(path)
    if not root:
        return file
    at = F.locate(f"/{root}/", file)
    return F.when(at > 0, F.substring(file, at + len(root) + 2, F.length(file))).otherwise(file)


def json_inputs(read: DataFrame, path: str) -> DataFrame:
    """``read`` without cleaned copies, with ``file_path`` and ``file_name``, the path below ``path``."""
    named = read.select("*", F.col("_metadata.file_path").alias("file_path"), below(path).alias("file_name"))
    return named.where(~F.rlike("file_name", F.lit(_COPY)))
