"""Operator 4: license scan, with DataFrame functions only.

1. **Units.**  Of every whole text: the identifiers after ``SPDX-License-Identifier:`` (level 4); headers, which are
   runs of comment lines, and for license files the whole text (level 3); paragraphs of headers and of plain
   text (level 2); sentences of lines and of paragraphs whose lines are joined (level 1).
2. **TF-IDF cosine.**  Units and templates (``license_texts.py``: statements, notices, licence texts) are sparse vectors
   over lower-case words and version numbers.  A word's weight is its count times ln((1 + N) / (1 + df)) + 1, where N
   counts all documents and df those that hold the word; words of no template have df 0.  Distinct units are
   scored once, by a join on words with the postings of the templates, and take the best template if its
   cosine reaches the threshold (ties: the first license by name).  Identifiers are compared with the known ones
   only, by plain counts and a threshold of their own.
3. **Candidates.**  Of each template the rarest words are its keys: as many as leave less than threshold^2 of its squared
   length to the others.  By Cauchy and Schwarz a unit without a key of a template stays below the threshold, so
   texts and units without any key are left out and nothing is lost; the SQL form scores every unit.
4. **Inheritance.**  A file's own license is that of its matching unit of the highest level, then score (ties: by
   name).  A directory's license is that of its license file (LICENSE, LICENCE, COPYING or NOTICE; the first path
   with a license if it has several).  A file without an own license takes that of the nearest ancestor
   directory, found by joining each distinct directory's ancestors with the licensed directories.

Templates are a parameter of fixed size, so their postings may be broadcast.  A common unit or a hot
directory is one row of the scored or resolved table; only that small table meets the many files.  Units are
told apart by a hash, so a long one is shuffled once and not with each of its words.

Null and empty texts have no unit and may inherit.  A null path has no directory and inherits
nothing.  Repeated rows give repeated results.  An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import license_texts
from daybook.llm.common import cut, table

THRESHOLD = 0.6
ID_THRESHOLD = 0.9
#: Patterns that Java and RE2 read alike.
SENTENCE_END = r"([.!?])[ \t]+"
BETWEEN_WORDS = r"[.]*[^\p{L}\p{N}.]+[.]*|\A[.]+|[.]+\z"
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"
WORD_SIGN = r"[\p{L}\p{N}]"
SPDX_TAG = "spdx-license-identifier:"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\r\n*<]*)"
BETWEEN_IDS = r"(?i)[ \t]+(?:or|and|with)[ \t]+|[()\n]+"
LICENSE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)([.][a-z]+)?$"
#: Marks between headers and, within a header, between its paragraphs.
RUN_END, PARAGRAPH_END = "\f", "\v"
BLANK = " \t\r\n"


def words(text):
    """Lower-case words and version numbers of a text column."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")


def _templates() -> list[tuple[str, str, str]]:
    return [("text", *t) for t in license_texts.texts()] + [("id", *t) for t in license_texts.identifiers()]


def template_words(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, template, license, word, n) of all templates."""
    rows = [(i, *t) for i, t in enumerate(templates)]
    return (
        spark.createDataFrame(rows, "template int, kind string, license string, text string")
        .select("kind", "template", "license", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("kind", "template", "license", "word")
        .agg(F.count("*").alias("n"))
    )


def _held(listed: list[str]):
    """Those of some words that a text has."""
    return F.array_intersect(F.split(F.lower("text"), BETWEEN_WORDS), F.array(*[F.lit(w) for w in listed]))


def word_weights(files: DataFrame, vocabulary: list[str], total: int) -> DataFrame:
    """(word, idf) of the templates' words, from all documents."""
    counted = files.select(F.explode(_held(vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known = files.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    return known.join(counted, "word", "left").select(
        "word", (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
    )


def weighed_templates(files: DataFrame, templates: list[tuple[str, str, str]], total: int) -> list:
    """(kind, word, template, license, idf, unit): as many rows as the templates have words."""
    per_template = template_words(files.sparkSession, templates)
    vocabulary = sorted(r["word"] for r in per_template.where("kind = 'text'").select("word").distinct().collect())
    rarities = word_weights(files, vocabulary, total).collect()
    idf = files.sparkSession.createDataFrame([tuple(r) for r in rarities], "word string, idf double")
    weight = F.col("n") * F.when(F.col("kind") == "id", 1.0).otherwise(F.col("idf"))
    weighed = per_template.join(idf, "word", "left").withColumn("weight", weight)
    lengths = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    unit = F.col("weight") / F.col("length")
    return weighed.join(lengths, "template").select("kind", "word", "template", "license", "idf", unit.alias("unit")).collect()


def key_words(postings: list, threshold: float) -> list[str]:
    """Words of which a unit needs one to reach the threshold with any text template."""
    templates: dict[int, list] = {}
    for row in postings:
        if row["kind"] == "text":
            templates.setdefault(row["template"], []).append(row)
    keys = set()
    for rows in templates.values():
        left = sum(r["unit"] ** 2 for r in rows)
        for row in sorted(rows, key=lambda r: (-r["idf"], r["word"])):
            if left < threshold**2 - 1e-6:
                break
            keys.add(row["word"])
            left -= row["unit"] ** 2
    return sorted(keys)


def _units(level: int, found):
    """Structs of level and unit, trimmed, of those with a letter or number."""
    trimmed = F.transform(found, lambda u: F.trim(u, F.lit(BLANK)))
    return F.transform(F.filter(trimmed, lambda u: u.rlike(WORD_SIGN)), lambda u: F.struct(F.lit(level).alias("level"), u.alias("unit")))


def units(files: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, path, dir, level, unit) of the texts and units that can match."""
    tagged = F.contains(F.lower("text"), F.lit(SPDX_TAG))
    can_match = files.where(tagged | (F.size(_held(keys)) > 0))
    plain = can_match.withColumn("text", F.translate("text", RUN_END + PARAGRAPH_END, "  "))
    lines = F.split("text", "\n")

    def in_header(line):
        comment = line.rlike(COMMENT)
        return F.when(comment & line.rlike(WORD_SIGN), line).when(comment, F.lit(PARAGRAPH_END)).otherwise(F.lit(RUN_END))

    def outside(line):
        return F.when(~line.rlike(COMMENT) & line.rlike(WORD_SIGN), line).otherwise(F.lit(RUN_END))

    marked = plain.withColumns(
        {
            "_runs": F.array_join(F.transform(lines, in_header), "\n"),
            "_rest": F.array_join(F.transform(lines, outside), "\n"),
        }
    )
    both = F.concat("_runs", F.lit(RUN_END), "_rest")
    marks = f"[{RUN_END}{PARAGRAPH_END}]"
    by_line = F.split(F.regexp_replace("text", SENTENCE_END, "$1\n"), "\n")
    joined = F.split(F.regexp_replace(F.translate(both, "\n", " "), SENTENCE_END, "$1" + RUN_END), marks)
    ids = F.split(F.array_join(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), "\n"), BETWEEN_IDS)
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        _units(4, ids),
        _units(3, F.split("_runs", RUN_END)),
        _units(3, whole),
        _units(2, F.split(both, marks)),
        _units(1, by_line),
        _units(1, joined),
    )
    each = marked.select("doc_id", "path", "dir", F.explode(F.array_distinct(found)).alias("_u")).select("doc_id", "path", "dir", "_u.*")
    return each.where((F.col("level") == 4) | F.arrays_overlap(words(F.col("unit")), F.array(*[F.lit(k) for k in keys])))


def scored_units(distinct: DataFrame, postings: DataFrame, unknown_idf: float, threshold: float) -> DataFrame:
    """(uid, license, score) of the units (uid, kind, unit) that reach the threshold."""
    counted = (
        distinct.select("uid", "kind", F.explode(words(F.col("unit"))).alias("word"))
        .groupBy("uid", "kind", "word")
        .agg(F.count("*").alias("n"))
    )
    idf = postings.where("kind = 'text'").select("word", "idf").distinct()
    one = F.when(F.col("kind") == "id", 1.0).otherwise(F.coalesce("idf", F.lit(unknown_idf)))
    weighed = counted.join(F.broadcast(idf), "word", "left").select("uid", "kind", "word", (F.col("n") * one).alias("weight"))
    norms = weighed.groupBy("uid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = (
        weighed.join(F.broadcast(postings.drop("idf")), ["kind", "word"])
        .groupBy("uid", "kind", "template", "license")
        .agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    )
    cosine = dots.join(norms, "uid").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    return (
        cosine.where(F.col("score") >= F.when(F.col("kind") == "id", ID_THRESHOLD).otherwise(threshold))
        .groupBy("uid")
        .agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
        .select("uid", F.col("best")["license"].alias("license"), (-F.col("best")["less"]).alias("score"))
    )


def scan(files: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, n_statements, own_license, own_score, own_level, license, inherited_from) of (doc_id, path, text).

    ``n_statements`` counts the file's different units that match.  ``templates`` are (kind, license, text) with
    kind ``text`` or ``id``.
    """
    spark = files.sparkSession
    files = files.select("doc_id", "path", "text", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    total = files.count()
    rows = weighed_templates(files, templates or _templates(), total)
    keys = key_words(rows, threshold)
    postings = spark.createDataFrame(
        [tuple(r) for r in rows], "kind string, word string, template int, license string, idf double, unit double"
    )
    unknown = float(spark.range(1).select(F.log(F.lit(1.0 + total)) + 1).first()[0])

    kind = F.when(F.col("level") == 4, "id").otherwise("text")
    # texts are cut into units once; grouped by uid alone, distinct units stay where they are until they are scored
    said = cut(units(files, keys).withColumn("kind", kind).withColumn("uid", F.unhex(F.sha2(F.concat("kind", F.lit(":"), "unit"), 256))))
    distinct = said.groupBy("uid").agg(F.max("kind").alias("kind"), F.max("unit").alias("unit"))
    scored = scored_units(distinct, postings, unknown, threshold)
    best = F.min(F.struct((-F.col("level")).alias("above"), (-F.col("score")).alias("less"), "license")).alias("best")
    own = (
        said.groupBy("doc_id", "path", "dir", "uid")
        .agg(F.max("level").alias("level"))
        .join(scored, "uid")
        .groupBy("doc_id", "path", "dir")
        .agg(F.count("*").alias("n_statements"), best)
        .select(
            "doc_id",
            "path",
            "dir",
            "n_statements",
            F.col("best")["license"].alias("own_license"),
            (-F.col("best")["less"]).alias("own_score"),
            (-F.col("best")["above"]).alias("own_level"),
        )
    )
    own = cut(own)
    licensed = (
        own.where(F.col("path").rlike(LICENSE_FILE))
        .groupBy(F.col("dir").alias("ancestor"))
        .agg(F.min(F.struct("path", "own_license"))["own_license"].alias("inherited"))
    )
    parts = F.split("dir", "/")
    ancestors = files.where("path IS NOT NULL").select("dir").distinct().select(
        "dir",
        F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"),
    )
    ancestors = ancestors.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = (
        ancestors.distinct()
        .join(licensed, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("near"))
        .select("dir", F.col("near")["ancestor"].alias("ancestor"), F.col("near")["inherited"].alias("inherited"))
    )
    found = own.drop("dir").withColumnRenamed("doc_id", "own_id").withColumnRenamed("path", "own_path")
    every = files.select("doc_id", "path", "dir")
    joined = every.join(
        found, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left"
    ).join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull() & F.col("path").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("n_statements", F.lit(0)).alias("n_statements"),
        "own_license",
        "own_score",
        "own_level",
        F.when(inherits, F.col("inherited")).otherwise(F.col("own_license")).alias("license"),
        F.when(inherits, F.col("ancestor")).alias("inherited_from"),
    )


#: Documents as files: a directory for each source and hundred ids, a license file in every fiftieth place.
AS_FILES = """
SELECT doc_id, text,
       source || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING) || '/'
       || CAST(CAST(floor(doc_id / 100) AS BIGINT) % 10 AS STRING) || '/'
       || CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS STRING) || '.txt' END AS path
FROM """


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "source")
    return scan(spark.sql(AS_FILES + "{docs}", docs=docs))


def oracle() -> str:
    """The scan as DuckDB SQL over ``documents``; every unit of every text is scored."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    listed = ",\n  ".join(f"({i}, {text(k)}, {text(n)}, {text(t)})" for i, (k, n, t) in enumerate(_templates()))
    between, sign, comment, ends = text(BETWEEN_WORDS), text(WORD_SIGN), text(COMMENT), text(SENTENCE_END)
    run_end, paragraph_end, line_end = "chr(12)", "chr(11)", "chr(10)"

    def word_list(column: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({column}), {between}), lambda w: w <> '')"

    def cleaned(found: str) -> str:
        return (
            f"list_filter(list_transform({found}, lambda u: trim(u, ' ' || chr(9) || chr(13) || chr(10))), "
            f"lambda u: regexp_matches(u, {sign}))"
        )

    return rf"""
WITH files AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({AS_FILES} documents)),
template AS (SELECT * FROM (VALUES {listed}) t(template, kind, license, body)),
template_word AS (
  SELECT kind, template, license, word, count(*) AS n
  FROM (SELECT kind, template, license, unnest({word_list("body")}) AS word FROM template) GROUP BY ALL),
frequency AS (
  SELECT word, count(*) AS df
  FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), {between}))) AS word FROM files)
  WHERE word IN (SELECT word FROM template_word) GROUP BY word),
idf AS (
  SELECT w.word, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT word FROM template_word WHERE kind = 'text') w LEFT JOIN frequency USING (word)),
template_weight AS (
  SELECT kind, word, template, license, n * CASE kind WHEN 'id' THEN 1.0::DOUBLE ELSE idf END AS weight
  FROM template_word LEFT JOIN idf USING (word)),
posting AS (
  SELECT kind, word, template, license, weight / sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS unit
  FROM template_weight),
plain AS (
  SELECT doc_id, path, dir, translate(text, chr(12) || chr(11), '  ') AS text FROM files WHERE text IS NOT NULL),
marked AS (
  SELECT *, array_to_string(list_transform(string_split(text, {line_end}), lambda s:
           CASE WHEN regexp_matches(s, {comment}) AND regexp_matches(s, {sign}) THEN s
                WHEN regexp_matches(s, {comment}) THEN {paragraph_end} ELSE {run_end} END), {line_end}) AS runs,
         array_to_string(list_transform(string_split(text, {line_end}), lambda s:
           CASE WHEN regexp_matches(s, {sign}) AND NOT regexp_matches(s, {comment}) THEN s ELSE {run_end} END), {line_end}) AS rest
  FROM plain),
both_parts AS (SELECT *, runs || {run_end} || rest AS parts FROM marked),
said AS (
  SELECT DISTINCT doc_id, path, dir, level, unit, CASE level WHEN 4 THEN 'id' ELSE 'text' END AS kind
  FROM (
    SELECT doc_id, path, dir, 4 AS level, unnest({cleaned(f"regexp_split_to_array(array_to_string(regexp_extract_all(text, {text(SPDX)}, 1), {line_end}), {text(BETWEEN_IDS)})")}) AS unit FROM both_parts
    UNION ALL SELECT doc_id, path, dir, 3, unnest({cleaned(f"string_split(runs, {run_end})")}) FROM both_parts
    UNION ALL SELECT doc_id, path, dir, 3, unnest({cleaned("[text]")}) FROM both_parts WHERE regexp_matches(path, {text(LICENSE_FILE)})
    UNION ALL SELECT doc_id, path, dir, 2, unnest({cleaned(f"string_split(replace(parts, {paragraph_end}, {run_end}), {run_end})")}) FROM both_parts
    UNION ALL SELECT doc_id, path, dir, 1,
      unnest({cleaned(f"string_split(regexp_replace(text, {ends}, chr(92) || '1' || {line_end}, 'g'), {line_end})")}) FROM both_parts
    UNION ALL SELECT doc_id, path, dir, 1,
      unnest({cleaned(f"string_split(replace(regexp_replace(replace(parts, {line_end}, ' '), {ends}, chr(92) || '1' || {run_end}, 'g'), {paragraph_end}, {run_end}), {run_end})")})
      FROM both_parts)),
counted AS (
  SELECT kind, unit, word, count(*) AS n
  FROM (SELECT kind, unit, unnest({word_list("unit")}) AS word FROM (SELECT DISTINCT kind, unit FROM said)) GROUP BY ALL),
weighed AS (
  SELECT kind, unit, word,
         n * CASE kind WHEN 'id' THEN 1.0::DOUBLE ELSE coalesce(idf, ln(1 + (SELECT count(*) FROM files)) + 1) END AS weight
  FROM counted LEFT JOIN idf USING (word)),
norm AS (SELECT kind, unit, sqrt(sum(weight * weight)) AS norm FROM weighed GROUP BY kind, unit),
scored AS (
  SELECT kind, unit, license, score
  FROM (SELECT w.kind, w.unit, license, round(sum(weight * p.unit) / any_value(norm), 6) AS score
        FROM weighed w JOIN posting p ON w.kind = p.kind AND w.word = p.word
        JOIN norm m ON w.kind = m.kind AND w.unit = m.unit GROUP BY w.kind, w.unit, template, license)
  WHERE score >= CASE kind WHEN 'id' THEN {ID_THRESHOLD} ELSE {THRESHOLD} END
  QUALIFY row_number() OVER (PARTITION BY kind, unit ORDER BY score DESC, license) = 1),
own AS (
  SELECT doc_id, path, dir, count(*) AS n_statements, min(struct_pack(above := -level, less := -score, license := license)) AS best
  FROM (SELECT doc_id, path, dir, kind, unit, max(level) AS level FROM said GROUP BY ALL) JOIN scored USING (kind, unit)
  GROUP BY doc_id, path, dir),
licensed AS (
  SELECT dir AS ancestor, min(struct_pack(path := path, license := best.license)).license AS inherited
  FROM own WHERE regexp_matches(path, {text(LICENSE_FILE)}) GROUP BY dir),
nearest AS (
  SELECT dir, max(struct_pack(depth := depth, ancestor := ancestor, inherited := inherited)) AS near
  FROM (SELECT DISTINCT dir, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') AS ancestor
        FROM (SELECT dir, unnest(generate_series(0, len(string_split(dir, '/')))) AS depth FROM (SELECT DISTINCT dir FROM files)))
  JOIN licensed USING (ancestor) GROUP BY dir)
SELECT f.doc_id, f.path, coalesce(n_statements, 0) AS n_statements, best.license AS own_license, -best.less AS own_score,
       -best.above AS own_level, coalesce(best.license, near.inherited) AS license,
       CASE WHEN best IS NULL THEN near.ancestor END AS inherited_from
FROM files f LEFT JOIN own ON f.doc_id = own.doc_id AND f.path = own.path LEFT JOIN nearest ON f.dir = nearest.dir"""
