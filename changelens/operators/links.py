"""Which file imports which file, as hash joins on typed keys.

Suffix rules (any source root, any package root) become equality by exploding every suffix of the target, so no
nested loop is needed. A key is ``<type>:<text>``: p path, m Python module, s JS stem, x JS stem suffix, c Java class,
k Java package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import paths
from changelens.functions.text import built_once, let
from changelens.operators.grouping import REVIEW, shuffled, unnest


def _keys(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


@built_once
def target_keys(path: str) -> Column:
    """Every key a file can be imported by."""
    where = paths.normalize_module_path(path)
    plain = paths.without_suffix(where)
    package = paths.dirname(where)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("p:"), where), F.concat(F.lit("s:"), paths.js_stem(path))),
            _keys("m", paths.python_modules(path)),
            _keys("x", paths.path_suffixes(paths.js_stem(path))),
            _keys("c", paths.dotted_suffixes(plain)),
            F.when(package != "", _keys("k", paths.dotted_suffixes(package))).otherwise(F.array().cast("array<string>")),
        )
    )


def import_keys(importer: str, item: Column, family: Column) -> Column:
    """Keys one import points at."""
    spec, level = item["spec"], item["level"]
    names = F.filter(item["names"], lambda n: n != "*")
    dotted = F.array_distinct(
        F.concat(F.array(spec), F.transform(names, lambda n: F.when(spec == "", n).otherwise(F.concat_ws(".", spec, n))))
    )
    folder = F.split(paths.dirname(paths.normalize_module_path(importer)), "/")
    base = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - (level - 1), F.lit(0)))
    joined = F.array_join(
        F.filter(F.concat(base, F.when(spec == "", F.array().cast("array<string>")).otherwise(F.split(spec, r"\."))), lambda p: p != ""),
        "/",
    )

    def candidates(at: Column) -> Column:
        named = lambda ending: F.transform(names, lambda n: F.concat(at, F.lit("/"), n, F.lit(ending)))
        whole = F.array(*[F.concat(at, F.lit(e)) for e in (".py", ".pyi", "/__init__.py")])
        return F.concat(whole, named(".py"), named("/__init__.py"))

    relative = let(F.when(joined == "", ".").otherwise(joined), candidates)
    python = F.when(level > 0, _keys("p", relative)).otherwise(_keys("m", dotted))
    stem = paths.js_resolve(importer, spec)
    js = F.array_compact(
        F.array(F.when(stem != "", F.concat(F.when(F.trim(spec).startswith("."), "s:").otherwise("x:"), stem)))
    )
    member = F.regexp_extract(spec, r"^(.*)\.[^.]*$", 1)
    java = F.when(item["wildcard"], F.array(F.concat(F.lit("k:"), spec))).otherwise(
        F.array_compact(
            F.array(
                F.concat(F.lit("c:"), spec), F.when(item["static"] & (member != ""), F.concat(F.lit("c:"), member))
            )
        )
    )
    return F.when(family == "python", python).when(family == "js", js).when(family == "java", java)


@built_once
def all_import_keys(importer: str, imports: str, language: str) -> Column:
    family = paths.family(language)
    return F.array_distinct(F.flatten(F.transform(imports, lambda i: import_keys(importer, i, family))))


def link_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo, sha, path, target): file ``path`` with its ``imports`` array and ``language`` points at ``target``."""
    points = unnest(files, [*REVIEW, "path"], all_import_keys("path", "imports", "language")).withColumnRenamed("item", "key")
    ends = unnest(targets, [*REVIEW, "target"], target_keys("target")).withColumnRenamed("item", "key")
    return points.join(shuffled(ends), [*REVIEW, "key"]).select(*REVIEW, "path", "target").distinct()


def same_package(left: str, right: str) -> Column:
    """Java classes of one directory need no import."""
    folder = lambda p: paths.dirname(paths.normalize_module_path(p))
    return folder(left) == folder(right)
