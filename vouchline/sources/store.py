"""A corpus on disk: versions of raw pages, parsed standards, readable texts and a manifest; requests and runs beside it.

A version is a folder with the tables ``raw`` (as_number, url, html, fetched_utc), ``json`` (a nested standard a line) and
``text`` (as_number, text) and the file ``manifest.json``, which is put in place last and in one step, so a folder without
one is no version. Raw pages are never written again.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import tempfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.functions.ident import corpus_fingerprint, digest_of
from vouchline.functions.text import series
from vouchline.operators import corpus
from vouchline.sources import html
from vouchline.sources.tables import MANIFEST, STANDARD, versions

#: What names a version, a run or a session: no path, nothing hidden.
SAFE = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,99}$"


class CorpusError(ValueError):
    """A corpus that is missing, empty or not what its manifest says."""


def is_safe(name: Column) -> Column:
    return F.coalesce(name.rlike(SAFE), F.lit(False))


def safe(name: str) -> str:
    if not re.match(SAFE, name) or name.endswith("\n"):
        raise CorpusError(f"not an identifier: {name!r}")
    return name


def now_utc() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def folder(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/{safe(version)}"


def write_json(path: str, value: object) -> None:
    """A small JSON file put in place in one step: written beside its place, flushed, renamed."""
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=where.parent, prefix=".new-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
            out.write(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(beside, where)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(beside)
        raise


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))


@contextlib.contextmanager
def writer(path: str) -> Iterator[None]:
    """The only writer below a folder while it lasts; a second one is refused."""
    Path(path).mkdir(parents=True, exist_ok=True)
    lock = Path(path) / ".writer.lock"
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise CorpusError(f"another writer holds {path}") from None
    try:
        yield
    finally:
        os.close(handle)
        lock.unlink()


def standards_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(url, html, fetched_utc) -> (nested standards, failures (url, error)): a page that is no standard stops nothing."""
    read = html.parse_pages(pages)
    facts = pages.select("url", F.sha2("html", 256).alias("source_sha256"), "fetched_utc")
    good = read.filter("ok").join(facts, "url").select("as_number", "title", "url", series(F.col("as_number")).alias("series"), "source_sha256", "fetched_utc", "notes", "sections", "footnotes")
    return good, read.filter("not ok").select("url", "error")


def _rows(parsed: DataFrame) -> DataFrame:
    """A manifest's row a standard."""
    counted = F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["paragraphs"]))
    return parsed.select("as_number", "title", "series", "url", F.col("source_sha256").alias("sha256"), F.size("sections").alias("sections"), counted.alias("paragraphs"), F.size("footnotes").alias("footnotes"))


def _manifest(parsed: DataFrame, version: str, index: str, notes: list[str]) -> dict:
    # A row a standard: the list of a corpus's documents, as the manifest holds it.
    rows = [r.asDict() for r in _rows(parsed).orderBy("as_number").collect()]
    found = corpus_fingerprint(parsed).first()[0]
    return {"corpus": "standards", "version": version, "downloaded_utc": now_utc(), "source_index": index, "standard_count": len(rows), "paragraph_count": sum(r["paragraphs"] for r in rows), "fingerprint": found, "notes": notes, "standards": rows}


def _write_parsed(parsed: DataFrame, where: str) -> None:
    parsed.select(F.to_json(F.struct(*parsed.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{where}/json")
    corpus.rendered(parsed).write.mode("overwrite").parquet(f"{where}/text")


def save(pages: DataFrame, root: str, version: str, index: str = "") -> DataFrame:
    """Write a version from pages(url, html, fetched_utc); returns the failures (url, error). Without a single standard
    nothing is a version, and an error says so."""
    where, spark = folder(root, version), pages.sparkSession
    with writer(where):
        pages.select("url", "html", "fetched_utc").write.parquet(f"{where}/raw")
        raw = spark.read.parquet(f"{where}/raw")
        parsed, failures = standards_of(raw)
        _write_parsed(parsed, where)
        held = load(spark, root, version)
        manifest = _manifest(held, version, index, [])
        if not manifest["standards"]:
            raise CorpusError("no standard among the pages")
        write_json(f"{where}/manifest.json", manifest)
    return failures


def download(fetched: DataFrame, index_page: DataFrame, base: str, root: str, version: str) -> DataFrame:
    """The whole way from an index page(html) and fetched(url, html, fetched_utc): links of the index, their pages, a saved
    version; returns the failures, also of links that weren't fetched. An index without links is an error."""
    links = html.index_links(index_page, base)
    if links.isEmpty():
        raise CorpusError("no standards on the index page")
    missing = links.join(fetched, "url", "left_anti").select("url", F.lit("not fetched").alias("error"))
    return save(fetched.join(links.select("url"), "url", "left_semi"), root, version, base).unionByName(missing)


def load(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The nested standards of a version."""
    return spark.read.schema(STANDARD).option("mode", "FAILFAST").option("lineSep", "\n").json(f"{folder(root, version)}/json")


def manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A version's manifest as one row with nested rows."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder(root, version)}/manifest.json")


def latest(spark: SparkSession, root: str) -> str | None:
    """The newest version by name; folders without a manifest don't count."""
    return max(versions(spark, root), default=None)


def reparse(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Parse the raw pages of a version again and put the new standards, texts and manifest in place of the old ones; the
    raw pages and the date of their download stay. Returns the failures."""
    where = folder(root, version)
    with writer(where):
        old = read_json(f"{where}/manifest.json")
        parsed, failures = standards_of(spark.read.parquet(f"{where}/raw"))
        _write_parsed(parsed, where)
        new = _manifest(load(spark, root, version), version, old["source_index"], old["notes"])
        write_json(f"{where}/manifest.json", new | {"downloaded_utc": old["downloaded_utc"]})
    return failures


def violations(manifest_row: DataFrame, raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """(code, subject) of whatever a version's manifest, raw pages(url, html) and parsed standards disagree in; no row means
    nothing. Twelve codes, each an anti-join, a comparison or a count."""
    entries = manifest_row.select(F.explode("standards").alias("x")).select("x.*")
    number = F.col("as_number")
    counted = _rows(parsed).select("as_number", F.col("url").alias("own_url"), F.col("sha256").alias("own_sha"), F.col("sections").alias("s"), F.col("paragraphs").alias("p"), F.col("footnotes").alias("f"))
    hashes = raw.select(F.col("url").alias("own_url"), F.sha2("html", 256).alias("raw_sha"))
    both = entries.join(counted, "as_number").join(hashes, "own_url", "left")
    flat = corpus.flattened(parsed)
    code = lambda name, rows, subject=number: rows.select(F.lit(name).alias("code"), subject.alias("subject"))
    totals = parsed.select(F.coalesce(F.sum(F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["paragraphs"]))), F.lit(0)).alias("total"))
    version = F.col("version")
    found = [
        code("empty_corpus", manifest_row.filter(F.size("standards") == 0), version),
        code("duplicate_manifest_entry", entries.groupBy("as_number").count().filter("count > 1")),
        code("manifest_count", manifest_row.filter(F.size("standards") != F.col("standard_count")), version),
        code("parsed_inventory", corpus.inventory(entries, parsed)),
        code("raw_inventory", entries.join(raw, "url", "left_anti")),
        code("source_checksum", both.filter(~(F.col("raw_sha").eqNullSafe(F.col("sha256")) & F.col("own_sha").eqNullSafe(F.col("sha256"))))),
        code("source_identity", both.filter(~F.col("url").eqNullSafe(F.col("own_url")))),
        code("source_counts", both.filter((F.col("s") != F.col("sections")) | (F.col("p") != F.col("paragraphs")) | (F.col("f") != F.col("footnotes")))),
        code("paragraph_label", flat.filter(~F.coalesce(F.col("number").rlike(corpus.LABEL), F.lit(False)))),
        code("ambiguous_paragraph", flat.groupBy("as_number", "number").count().filter("count > 1")),
        code("paragraph_total", manifest_row.join(totals).filter(F.col("paragraph_count") != F.col("total")), version),
        code("corpus_fingerprint", manifest_row.join(corpus_fingerprint(parsed).withColumnRenamed("fingerprint", "found")).filter(F.col("fingerprint") != F.col("found")), version),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def inspect(spark: SparkSession, root: str, version: str) -> DataFrame:
    """``violations`` of a version on disk."""
    return violations(manifest(spark, root, version), spark.read.parquet(f"{folder(root, version)}/raw"), load(spark, root, version))


def sealed(value: dict) -> dict:
    """A request as it is stored: with the digest of everything else in it."""
    return {**value, "artifact_sha256": digest_of({k: v for k, v in value.items() if k != "artifact_sha256"})}


def put_request(root: str, value: dict) -> None:
    write_json(f"{root}/requests/{safe(str(value['id']).replace(':', '_'))}.json", sealed(value))


def requests(spark: SparkSession, root: str) -> DataFrame:
    """(id, stage, key, state, text, sound) of the stored requests; ``sound`` is whether one is as it was sealed."""
    from vouchline.functions.ident import canonical

    files = spark.read.text(f"{root}/requests/*.json", wholetext=True)
    one = files.select(canonical(F.col("value")).alias("text"))
    seal = F.get_json_object("text", "$.artifact_sha256")
    # In canonical form the seal is one piece of text, which taken out leaves the canonical form of the rest.
    rest = F.replace(F.replace(F.col("text"), F.concat(F.lit('"artifact_sha256":"'), seal, F.lit('",')), F.lit("")), F.concat(F.lit(',"artifact_sha256":"'), seal, F.lit('"')), F.lit(""))
    fields = [F.get_json_object("text", f"$.{name}").alias(name) for name in ("id", "stage", "key", "state")]
    return one.select(*fields, "text", F.coalesce(F.sha2(rest, 256) == seal, F.lit(False)).alias("sound"))


def latest_run(manifests: DataFrame) -> DataFrame:
    """manifests(value: JSON text) -> one row (run_id) of the run finalized last, none without one; what is no manifest is
    passed over."""
    rows = manifests.select(*[F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "string").alias(name) for name in ("state", "finalized_utc", "run_id")])
    done = rows.filter("state = 'finalized' and finalized_utc is not null and run_id is not null")
    return done.agg(F.max(F.struct("finalized_utc", "run_id")).alias("x")).filter("x is not null").select("x.run_id")


def write_inventory(spark: SparkSession, root: str) -> dict[str, str]:
    """{path below root: sha256} of a run's files, by path; the manifest and the lock aside."""
    from vouchline.sources.tables import file_hashes

    base = Path(root).resolve().as_uri() + "/"
    rows = file_hashes(spark, root).select(F.replace(F.regexp_replace("path", "^file:/+", "file:///"), F.lit(base), F.lit("")).alias("path"), "sha256")
    return {r["path"]: r["sha256"] for r in rows.filter(~F.col("path").rlike(r"(^|/)(manifest\.json|\.writer\.lock|\..*\.crc)$")).orderBy("path").collect()}


def missing_artifacts(inventory: Column, *required: str) -> Column:
    """Which of the required files an inventory (a map by path) lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(inventory))

