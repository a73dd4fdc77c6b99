"""Languages of repositories from their file trees and from metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import path_elements, path_extension

# Fixed values: (extension, language).
EXTENSION_LANGUAGE = (
    (".go", "go"),
    (".js", "javascript"),
    (".jsx", "javascript"),
    (".ts", "javascript"),
    (".tsx", "javascript"),
    (".py", "python"),
    (".java", "java"),
    (".kt", "java"),
    (".cs", "csharp"),
    (".cpp", "cpp"),
    (".c", "cpp"),
    (".h", "cpp"),
    (".hpp", "cpp"),
    (".cc", "cpp"),
    (".rb", "ruby"),
    (".php", "php"),
    (".rs", "rust"),
    (".swift", "swift"),
    (".m", "swift"),
)
# Fixed values.
PRUNED_DIRECTORIES = (".git", "node_modules", "vendor", "dist", ".github")
RELEVANT_FILES = 3
DEFAULT_LANGUAGE, DEFAULT_ECOSYSTEM = "javascript", "npm"
SCANNER_LANGUAGE = {
    "go": ("go", "golang"),
    "javascript": ("javascript", "typescript", "jsx", "tsx"),
    "python": ("python",),
    "java": ("java", "kotlin"),
    "csharp": ("c#", "csharp"),
    "cpp": ("c", "c++", "cpp"),
    "ruby": ("ruby",),
}
ECOSYSTEM = {
    "gomod": ("go", "golang"),
    "npm": ("javascript", "typescript", "jsx", "tsx"),
    "pip": ("python",),
    "maven": ("java", "kotlin"),
    "nuget": ("c#", "csharp"),
    "bundler": ("ruby",),
    "composer": ("php",),
    "cargo": ("rust",),
}


def in_pruned_directory(path: Column) -> Column:
    """True when a directory of the path is pruned; the file name does not count."""
    elements = path_elements(path)
    directories = F.slice(elements, F.lit(1), F.size(elements) - 1)
    return F.arrays_overlap(directories, F.array(*[F.lit(d) for d in PRUNED_DIRECTORIES]))


def pruned_tree(tree: DataFrame) -> DataFrame:
    return tree.where(~in_pruned_directory(F.col("path")))


def extension_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXTENSION_LANGUAGE), "ext string, language string")


def _with_language(tree: DataFrame, how: str) -> DataFrame:
    extension = F.when(~in_pruned_directory(F.col("path")), path_extension(F.col("path")))
    return tree.select("full_name", extension.alias("ext")).join(
        F.broadcast(extension_table(tree.sparkSession)), "ext", how
    )


def language_counts(tree: DataFrame) -> DataFrame:
    """Files per repository and language."""
    return (
        _with_language(tree, "inner")
        .groupBy("full_name", "language")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def detect_languages(tree: DataFrame) -> DataFrame:
    """``full_name, detected, language`` for every repository of the tree.

    Several languages with three or more files each are joined; otherwise the
    most common one is taken (equal counts: first by name). Repositories without
    any known file get the default and an empty ``detected``.
    """
    counts = (
        _with_language(tree, "left")
        .groupBy("full_name", "language")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    known = F.col("language").isNotNull()
    # At most one row per language and repository is gathered here.
    gathered = counts.groupBy("full_name").agg(
        F.array_sort(F.collect_list("language")).alias("all"),
        F.array_sort(
            F.collect_list(F.when(F.col("files") >= RELEVANT_FILES, F.col("language")))
        ).alias("relevant"),
        F.min(F.when(known, F.struct((-F.col("files")).alias("n"), "language"))).alias("top"),
    )
    return gathered.select(
        "full_name",
        F.array_join("all", ", ").alias("detected"),
        F.when(F.size("all") == 0, F.lit(DEFAULT_LANGUAGE))
        .when(F.size("relevant") > 1, F.array_join("relevant", ", "))
        .otherwise(F.col("top.language"))
        .alias("language"),
    )


def _normalise(value: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    pairs = [F.lit(x) for target, names in table.items() for n in names for x in (n, target)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(value)), F.lit(default))


def scanner_language(metadata_language: Column) -> Column:
    """Scanner language for the language named in repository metadata."""
    return _normalise(metadata_language, SCANNER_LANGUAGE, DEFAULT_LANGUAGE)


def ecosystem(language: Column) -> Column:
    """Package ecosystem of a language; a joined list gets the default."""
    return _normalise(language, ECOSYSTEM, DEFAULT_ECOSYSTEM)
