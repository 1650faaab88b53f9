"""Checks of id-list outputs, all rules in one pass over their lines.

Every line sends a message to its entity and one to each of its ids; required entities and known ids send one as
well. Messages meet by entity or id once, each group says which rules it breaks, and one row for each rule is left.
Messages of a group are aggregated before they travel, so an id in all lists or an entity on all rows is no hot key.
Findings are rows (file, rule, severity, n, examples): n counts distinct items, examples are the first five in order.
Severity info is what is no fault: `rows`, `empty rows` and the `header`.
"""

from __future__ import annotations

import argparse
import heapq
import sys
from collections import defaultdict

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.sources.tsv import CANDIDATES, GROUND_TRUTH, first_fields, read_lines

EXAMPLES = 5
SEVERAL, REPEATED, SELF, PREFIX, MISSING, EXTRA, UNKNOWN, OUTSIDE = "entity on several rows", "id repeated in a list", "source-1 id in a list", "id without S2- or S3-", "required entity missing", "entity not asked for", "unknown id", "match is no candidate"
NO_TAB, NOT_UTF8, HEADER = "no tab", "not UTF-8 text", "header"
_KNOWN = "*"


def _message(about: Column | str, item: Column, ids: Column | None = None) -> Column:
    about = F.lit(about) if isinstance(about, str) else about
    return F.struct(about.alias("about"), item.cast("string").alias("item"), (F.lit(None) if ids is None else ids).cast("array<string>").alias("ids"))


def _row_messages(line: Column, s1: Column, ids: Column) -> Column:
    return F.concat(F.array(_message("entity", s1, ids)), F.transform(F.array_distinct(ids), lambda i: _message("id", i)))


def row_messages(rows: DataFrame, file: str) -> DataFrame:
    """What rows (line, s1, ids) of a file say to their entity and to each of their ids."""
    return _sent(rows, _row_messages(F.col("line"), F.col("s1"), F.col("ids")), file)


def line_messages(lines: DataFrame, file: str) -> DataFrame:
    """What lines (line, value) of a file say: its header, lines that are no rows, and rows."""
    value, line = F.col("value"), F.col("line")
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    ids = F.when(rest.rlike(r"^\s*$"), F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    place = F.concat(F.lit("line "), line)
    bad = F.when(~F.is_valid_utf8(value), F.array(_message(NOT_UTF8, place)))
    said = bad.when(line == 1, F.array(_message(HEADER, value))).when(F.instr(value, "\t") > 0, _row_messages(line, F.substring_index(value, "\t", 1), ids))
    return _sent(lines, said.when(~value.rlike(r"^\s*$"), F.array(_message(NO_TAB, place))), file)


def _sent(df: DataFrame, said: Column, file: str) -> DataFrame:
    return df.select("line", F.explode(said).alias("m")).select("m.about", "m.item", F.lit(file).alias("file"), "line", "m.ids")


def _known(about: str, ids: DataFrame) -> DataFrame:
    return ids.select(F.lit(about).alias("about"), F.col("entity_id").alias("item"), F.lit(_KNOWN).alias("file"), F.lit(0).cast("long").alias("line"), F.lit(None).cast("array<string>").alias("ids"))


def offences(messages: dict[str, DataFrame], required: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """(file, rule, severity, item, n) for every distinct item that breaks a rule, from the messages of each file.

    required and valid have entity_id, in any number of rows each; without them the rules that need them are left out.
    With files `matching` and `candidate` the last row of an entity in each is compared, an entity without candidates has none.
    """
    sent = [*messages.values(), *([] if required is None else [_known("entity", required)]), *([] if valid is None else [_known("id", valid)])]
    every = sent[0]
    for m in sent[1:]:
        every = every.unionByName(m)
    sums = [F.count_if(F.col("file") == _KNOWN).alias("known")]
    for k, file in enumerate(messages):
        own = F.col("file") == file
        last = F.max_by(F.when(own, F.col("ids")), F.when(own, F.col("line")))
        repeated = F.coalesce(F.bool_or(own & (F.size("ids") != F.size(F.array_distinct("ids")))), F.lit(False))
        sums += [F.count_if(own).alias(f"n{k}"), F.count_if(own & (F.size("ids") == 0)).alias(f"empty{k}"), repeated.alias(f"repeated{k}"), last.alias(f"last{k}")]
    known, entity, one_id, found = F.col("known") > 0, F.col("about") == "entity", F.col("about") == "id", []

    def rule(file: str, name: Column | str, breaks: Column, severity: str = "error", n: Column | None = None) -> None:
        name, item = F.lit(name) if isinstance(name, str) else name, F.when(F.lit(n is None), F.col("item"))
        found.append(F.when(breaks, F.struct(F.lit(file).alias("file"), name.alias("rule"), F.lit(severity).alias("severity"), item.alias("item"), (F.lit(1) if n is None else n).cast("long").alias("n"))))

    for k, file in enumerate(messages):
        n, empty = F.col(f"n{k}"), F.col(f"empty{k}")
        rule(file, "rows", entity & (n > 0), "info", n)
        rule(file, "empty rows", entity & (empty > 0), "info", empty)
        rule(file, HEADER, (F.col("about") == HEADER) & (n > 0), "info")
        rule(file, F.col("about"), F.col("about").isin(NO_TAB, NOT_UTF8) & (n > 0))
        rule(file, SEVERAL, entity & (n > 1))
        rule(file, REPEATED, entity & F.col(f"repeated{k}"))
        rule(file, SELF, one_id & (n > 0) & F.startswith("item", F.lit("S1-")))
        rule(file, PREFIX, one_id & (n > 0) & ~F.col("item").rlike("^S[123]-"))
        if required is not None:
            rule(file, MISSING, entity & known & (n == 0))
            rule(file, EXTRA, entity & ~known & (n > 0))
        if valid is not None:
            rule(file, UNKNOWN, one_id & ~known & (n > 0) & F.col("item").rlike("^S[23]-"))
    if {"matching", "candidate"} <= set(messages):
        none, at = F.array().cast("array<string>"), list(messages).index
        outside = F.array_except(F.coalesce(f"last{at('matching')}", none), F.coalesce(f"last{at('candidate')}", none))
        rule("matching", OUTSIDE, entity & (F.size(outside) > 0), "warning")
    return every.groupBy("about", "item").agg(*sums).select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def summary(found: DataFrame) -> DataFrame:
    """(file, rule, severity, n, examples) of offences: a task keeps a sum and five examples for each rule, and these are merged."""

    def run(batches):
        total, first = defaultdict(int), defaultdict(list)
        for batch in batches:
            new = defaultdict(list)
            for file, name, severity, item, n in zip(*(batch.column(c).to_pylist() for c in ("file", "rule", "severity", "item", "n")), strict=True):
                total[file, name, severity] += n
                if item is not None:
                    new[file, name, severity].append(item)
            for key, items in new.items():
                first[key] = heapq.nsmallest(EXAMPLES, first[key] + items)
        cells = [[*key, n, first[key]] for key, n in total.items()]
        columns = list(zip(*cells, strict=True)) if cells else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "rule", "severity", "n", "examples"])

    parts = found.mapInArrow(run, "file string, rule string, severity string, n bigint, examples array<string>")
    return parts.groupBy("file", "rule", "severity").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, EXAMPLES).alias("examples"))


def _items(found: DataFrame, rule: str) -> DataFrame:
    return found.where(F.col("rule") == rule).select("item")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}), SEVERAL)


def repeated_ids(rows: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}), REPEATED)


def self_matches(rows: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}), SELF)


def wrong_prefixes(rows: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}), PREFIX)


def unknown_ids(rows: DataFrame, valid: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}, valid=valid), UNKNOWN)


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}, required), MISSING)


def extra_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return _items(offences({"matching": row_messages(rows, "matching")}, required), EXTRA)


def outside_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with a match that isn't among their candidates; of rows that repeat an entity the last one counts."""
    return _items(offences({"matching": row_messages(matching, "matching"), "candidate": row_messages(candidates, "candidate")}), OUTSIDE)


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum((F.size("ids") == 0).cast("long")), F.lit(0)).alias("n_empty")).withColumn("n_listed", F.col("n_rows") - F.col("n_empty"))


def header_fault(first_line: str | None, expected: list[str]) -> str | None:
    if first_line is None:
        return "the file is empty"
    if "\t" not in first_line and "," in first_line:
        return "fields are separated by commas; tabs are needed"
    if [c.strip().lower() for c in first_line.split("\t")] != expected:
        return f"the header must be {expected}"
    return None


def validate_outputs(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> tuple[list, list]:
    """(errors, warnings) as (file, rule, n, examples); a file with a wrong header or other text than UTF-8 has no further findings."""
    errors, warnings, valid = [], [], None

    def known(*sources: str) -> DataFrame:
        found = [first_fields(read_lines(spark, f"{test_dir}/{s}").where(F.col("line") > 1)) for s in sources]
        return found[0] if len(found) == 1 else found[0].union(found[1])

    try:
        required = known("test_source1.tsv")
    except AnalysisException:
        return [("test_source1.tsv", "not found", 1, [])], []
    if check_ids:
        try:
            valid = known("test_source2.tsv", "test_source3.tsv")
        except AnalysisException:
            warnings.append(("test_source2/3.tsv", "not found: ids aren't checked", 1, []))
    else:
        warnings.append(("ids", "existence isn't checked", 1, []))
    messages, headers = {}, {"matching": GROUND_TRUTH.names, "candidate": CANDIDATES.names}
    for name, path in (("matching", matching), ("candidate", candidate)):
        try:
            if path:
                messages[name] = line_messages(read_lines(spark, path), name)
        except AnalysisException:
            pass
        if name not in messages:
            (errors if name == "matching" else warnings).append((name, "not found", 1, []))
    if not messages:
        return errors, warnings
    found = {(r["file"], r["rule"]): r for r in summary(offences(messages, required, valid)).collect()}  # a row for each rule
    whole = set()
    for name in messages:
        header = found.get((name, HEADER))
        if bad := found.get((name, NOT_UTF8)):
            errors.append((name, NOT_UTF8, bad["n"], []))
        elif fault := header_fault(header["examples"][0] if header else None, headers[name]):
            errors.append((name, fault, 1, []))
        else:
            whole.add(name)
            n, empty = (found[name, r]["n"] if (name, r) in found else 0 for r in ("rows", "empty rows"))
            print(f"{name}: {n} rows ({empty} empty, {n - empty} with ids)")
    for (file, rule), r in sorted(found.items()):
        if file in whole and r["severity"] != "info" and (rule != OUTSIDE or len(whole) == 2):
            (errors if r["severity"] == "error" else warnings).append((file, rule, r["n"], r["examples"]))
    return errors, warnings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Checks matching and candidate id lists.")
    parser.add_argument("--matching", "-m", default="output/matching_results.tsv")
    parser.add_argument("--candidate", "-c", default="output/candidate_pairs.tsv")
    parser.add_argument("--test-dir", "-t", default="dataset/test")
    parser.add_argument("--check-ids", action="store_true")
    a = parser.parse_args(argv)
    try:
        errors, warnings = validate_outputs(SparkSession.builder.getOrCreate(), a.matching, a.candidate, a.test_dir, a.check_ids)
    except PySparkException as e:  # a file that is there and can't be read
        errors, warnings = [(a.matching, str(e).splitlines()[0], 1, [])], []
    for kind, items in (("warning", warnings), ("error", errors)):
        for file, rule, n, some in items:
            print(f"{kind}: {file}: {rule} ({n}) {', '.join(some)}")
    print("FAIL" if errors else "PASS")
    return int(bool(errors))


if __name__ == "__main__":
    sys.exit(main())
