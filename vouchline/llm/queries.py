"""The queries of this folder and, where SQL can say them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vouchline.llm import components, defects, mixing, neardup, sampling, splits, stuffing, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _of(build: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(*(_table(spark, folder, name) for name in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _of(splits.found, "decisions", "former_labels"),
    "p1_splits": _of(splits.splits, "decisions", "former_labels"),
    "p1_report": _of(splits.report, "decisions", "former_labels"),
    "p2_found": _of(components.found, "duplicates"),
    "p3_found": _of(sampling.found, "decisions", "sample_targets", "former_labels"),
    "p3_report": _of(lambda d, t, f: sampling.Sample(d, t, f).report(), "decisions", "sample_targets", "former_labels"),
    "p3_plans": _of(lambda d, t, f: sampling.Sample(d, t, f).plans(), "decisions", "sample_targets", "former_labels"),
    "p3_sample": _of(lambda d, t, f: sampling.Sample(d, t, f).rows(), "decisions", "sample_targets", "former_labels"),
    "p4_found": _of(neardup.found, "candidates"),
    "p4_groups": _of(neardup.groups, "candidates"),
    "p5_found": _of(defects.found, "candidates"),
    "p6_ids": _of(tokens.encoded, "documents"),
    "p8_found": _of(stuffing.found, "documents"),
    "p7_found": _of(mixing.found, "documents", "mix_targets"),
    "p7_report": _of(lambda d, t: mixing.Mix(d, t).report(), "documents", "mix_targets"),
    "p7_mix": _of(lambda d, t: mixing.Mix(d, t).rows(), "documents", "mix_targets"),
}

# Full-width signs and the plain ones they stand for, as the keys module reads them.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SPACES = r"[\s\p{Z}\x{200B}\x{FEFF}]"


def _plain(text: str) -> str:
    return f"lower(regexp_replace(translate({text}, '{_WIDE}', '{_NARROW}'), '{_SPACES}', ' ', 'g'))"


def _number(text: str) -> str:
    word = r"[^\p{L}\p{Nd}]"
    after = rf"regexp_extract({_plain(text)}, '(?:^|{word})a\.? ?s\.?{word}*(\d{{4}})(?:\D|$)', 1)"
    alone = rf"regexp_extract({_plain(text)}, '^{word}*(\d{{4}})(?:\.(?:\d{{2}}[a-z]?|[a-z]\d+))?{word}*$', 1)"
    return f"'AS ' || coalesce(nullif({after}, ''), nullif({alone}, ''))"


def _label(text: str) -> str:
    return rf"regexp_replace({_plain(text)}, '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def _slug(text: str) -> str:
    joined = rf"regexp_replace({_plain(text)}, '[^\p{{L}}\p{{Nd}}]+', '_', 'g')"
    return f"nullif(regexp_replace({joined}, '^_+|_+$', '', 'g'), '')"


ORACLES: dict[str, str] = {
    # Every two questions with a word in common; whole tables at the scale of the comparison.
    "p4_found": rf"""
        WITH said AS (
            SELECT DISTINCT id, raw->>'question' AS question FROM (SELECT id, TRY_CAST(raw AS JSON) AS raw FROM candidates WHERE id IS NOT NULL AND json_valid(raw))
            WHERE json_type(raw) = 'OBJECT' AND json_type(raw->'question') = 'VARCHAR'),
        bags AS (SELECT id, list_distinct(regexp_extract_all(replace({_plain("question")}, 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+(?:\.\p{{Nd}}+)?')) AS w FROM said),
        classes AS (SELECT list_sort(w) AS w, row_number() OVER () AS c, list(id) AS ids FROM bags WHERE len(w) > 0 GROUP BY 1),
        each AS (SELECT c, len(w) AS n, unnest(w) AS t FROM classes),
        near AS (SELECT a.c AS x, b.c AS y FROM each a JOIN each b ON a.t = b.t AND a.c < b.c AND a.n <= b.n / 0.7 AND b.n <= a.n / 0.7 GROUP BY a.c, b.c
            HAVING 10 * count(*) >= 7 * (any_value(a.n) + any_value(b.n) - count(*))),
        members AS (SELECT c, unnest(ids) AS id FROM classes),
        pairs AS (SELECT l.id AS a, r.id AS b FROM near JOIN members l ON l.c = x JOIN members r ON r.c = y UNION ALL SELECT l.id, r.id FROM members l JOIN members r ON l.c = r.c AND l.id < r.id)
        SELECT least(a, b) AS left_id, greatest(a, b) AS right_id FROM pairs""".replace("\\\\", "\\"),
    "p1_found": f"""
        WITH RECURSIVE labels AS (
            SELECT {_label("former_label")} AS label, min(as_number) AS was FROM former_labels GROUP BY 1),
        said AS (
            SELECT DISTINCT candidate_id, record.group_key AS written, standard FROM decisions WHERE candidate_id IS NOT NULL),
        keyed AS (
            SELECT candidate_id, written, coalesce({_number("written")}, a.was) AS k, coalesce({_number("said.standard")}, b.was) AS o
            FROM said LEFT JOIN labels a ON {_label("written")} = a.label LEFT JOIN labels b ON {_label("said.standard")} = b.label),
        edges AS (SELECT DISTINCT k AS a, o AS b FROM keyed WHERE k <> o UNION SELECT DISTINCT o, k FROM keyed WHERE k <> o),
        reach(v, r) AS (SELECT a, a FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a),
        names AS (SELECT v, min(r) AS name FROM reach GROUP BY v)
        SELECT DISTINCT candidate_id, coalesce(name, k, o) AS group_standard
        FROM keyed LEFT JOIN names ON names.v = coalesce(k, o)
        WHERE coalesce(k, o) IS NOT NULL AND written IS DISTINCT FROM coalesce(name, k, o)""",
    "p2_found": r"""
        WITH RECURSIVE pairs AS (
            SELECT DISTINCT lower(regexp_replace("left", '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace("right", '^\s+|\s+$', '', 'g')) AS b
            FROM duplicates WHERE regexp_replace(lower(regexp_replace(result, '^\s+|\s+$', '', 'g')), ' *\.$', '') = 'duplicate'),
        edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
        reach(v, r) AS (SELECT a, a FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a)
        SELECT v AS record_id, min(r) AS group_id FROM reach GROUP BY v""",
    "p3_found": f"""
        WITH labels AS (
            SELECT {_label("former_label")} AS label, min(as_number) AS was FROM former_labels GROUP BY 1),
        facts AS (
            SELECT candidate_id, coalesce({_number("standard")}, was) AS named,
                CASE WHEN record IS NULL THEN 'malformed' ELSE {_slug("record.task_type")} END AS task,
                [{_slug("x")} FOR x IN coalesce(reasons, [])] AS why
            FROM decisions LEFT JOIN labels ON {_label("standard")} = label WHERE candidate_id IS NOT NULL),
        sizes AS (
            SELECT target_id, min_rows, target_share, sample_fraction, count(DISTINCT candidate_id) AS n
            FROM sample_targets t LEFT JOIN facts ON (t.standard IS NULL OR named = t.standard)
                AND (task_type IS NULL OR task = task_type) AND (reason IS NULL OR list_contains(why, reason))
            GROUP BY ALL)
        SELECT target_id FROM sizes
        WHERE n < min_rows OR n < target_share * sample_fraction * (SELECT count(DISTINCT candidate_id) FROM decisions)""",
}
