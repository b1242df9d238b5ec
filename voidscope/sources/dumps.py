"""Distributed scan of LAMMPS text dumps.

Files are read as splittable text, so one large dump is parsed by many tasks. A first pass keeps only marks and
blank lines, per file block; from these a small table says which section every block is in and how many lines and
blanks came before. The second pass joins that table to the lines where they are read, numbers each row from its
position, parses it once for both readers and writes the numbers. No text is copied, and none is shuffled while
the table (one row per file block) is below the broadcast threshold.

Every file is known by its whole path; the name that results carry must be different for each file. A file of many
frames gives its first one, or all of them: the frame of a section is the number of atoms sections before it, counted
per block and carried over the blocks of a file.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voidscope.functions.spread import attach, with_last_chunk
from voidscope.session import stage

# Section marks, skipped file ending, extra column cap, fallback coordinate columns.
MARK = "ITEM:"
ATOMS_MARK = "ITEM: ATOMS"
COUNT_MARK = "ITEM: NUMBER OF ATOMS"
BOUNDS_MARK = "ITEM: BOX BOUNDS"
SKIPPED_ENDING = "_surface_normalized.dump"
MAX_EXTRA = 7
FALLBACK_COLUMNS = {"x": 2, "y": 3, "z": 4}

OK, NO_ATOMS, NO_COORDINATES, BAD_VALUE = "ok", "no atoms section", "missing x, y or z", "bad value"
NO_BOUNDS, FEWER_ROWS, TILTED = "no box bounds", "fewer rows than declared", "tilted box"
TILT_WORDS = ("xy", "xz", "yz")
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_WAVES = 8  # tasks per core that list folders
CHUNK = 10  # bits of the line number inside one chunk of section starts
FAILED_NAMES = 10
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _decoded(path: Column) -> Column:
    """Path without scheme and authority, percent codes undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, _SCHEME, ""), r"\+", "%2B"))


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\v"))


def _tokens(line: Column) -> Column:
    return F.split(_stripped(line), r"\s+")


def _number(parts: Column, position: Column) -> Column:
    """Token at a 1-based position as double; NULL if absent or not a number."""
    return F.get(parts, (position - 1).cast("int")).try_cast("double")


class DumpScan:
    """First or every frame of every dump below ``path`` (a directory or glob).

    A file is named by its path below the part of ``path`` that has no wildcard (in one flat folder: the file
    name), or by the first group of ``name_pattern`` in its whole path. Two files of one name are an error. With
    ``first_frame`` a snapshot has the name of its file, else that name, ``#`` and the number of the frame from 0.
    Marks after the last atoms section of a file are a frame without atoms.
    """

    def __init__(
        self, spark: SparkSession, path: str, max_extra: int = MAX_EXTRA, name_pattern: str | None = None,
        first_frame: bool = True,
    ):
        self.spark, self.path, self.max_extra, self.name_pattern = spark, path, max_extra, name_pattern
        self.first_frame = first_frame

    def _name(self, path: Column) -> Column:
        if self.name_pattern is not None:
            return F.regexp_extract(path, self.name_pattern, 1)
        fixed = re.split(r"[*?\[{]", re.sub(_SCHEME, "", self.path))
        root = (fixed[0].rpartition("/")[0] if len(fixed) > 1 else fixed[0].rstrip("/")) + "/"
        at = F.instr(path, root)
        below = F.substring(path, at + len(root), F.length(path))
        return F.when(at > 0, below).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))

    @cached_property
    def _text(self) -> DataFrame:
        """Lists the folder once. With a folder per file, one task per folder would cost more than its listing."""
        allowed = self.spark.conf.get(LISTING)
        self.spark.conf.set(LISTING, min(int(allowed), LISTING_WAVES * self.spark.sparkContext.defaultParallelism))
        try:
            return self.spark.read.text(self.path)
        finally:
            self.spark.conf.set(LISTING, allowed)

    @cached_property
    def files(self) -> DataFrame:
        """``path, file`` of every file. Spark's own listing, which the driver holds for any read, is written once:
        empty files have no line, and no source format returns them."""
        listed = self.spark.createDataFrame([(p,) for p in self._text.inputFiles()], "path string")
        listed = listed.select(_decoded(F.col("path")).alias("path")).distinct()
        files = stage(listed.withColumn("file", self._name(F.col("path"))).filter(
            ~F.col("file").endswith(SKIPPED_ENDING)), "files")
        twice = files.groupBy("file").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1").first()
        if twice:
            raise ValueError(f"{twice['n']} files are named {twice['file']!r}, one of them {twice['path']}")
        return files

    def _lines(self) -> DataFrame:
        """Lines as they are read, with the path as Spark writes it: it is decoded once per block, not per line. ``pos``
        grows within a block; the file listing is fixed, so a second reading gives the same positions."""
        return self._text.select(
            F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), "value")

    @cached_property
    def _blocks(self) -> DataFrame:
        """Per file block: what to add to ``pos`` for the line number in the file, its blank lines, the blanks of
        earlier blocks, and its marks with the blanks before each."""
        value = F.col("value")
        blank = F.length(_stripped(value)) == 0
        mark = F.when(value.startswith(MARK), F.struct("pos", _stripped(value).alias("header")))
        found = self._lines().groupBy("source", "block").agg(
            F.min("pos").alias("first"), F.count("*").alias("n"),
            F.sort_array(F.collect_list(mark)).alias("marks"),
            F.sort_array(F.collect_list(F.when(blank, F.col("pos")))).alias("blanks")
        ).withColumn("path", _decoded(F.col("source")))
        earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumns({
            "shift": F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"),
            "before": F.coalesce(F.sum(F.size("blanks")).over(earlier), F.lit(0)),
        }).withColumn("blanks", F.transform("blanks", lambda p: p + F.col("shift")))
        marks = F.transform("marks", lambda m: F.struct(
            (m["pos"] + F.col("shift")).alias("line"), m["header"].alias("header"),
            m["header"].startswith(ATOMS_MARK).cast("long").alias("atoms"),
            (F.col("before") + F.size(F.filter("blanks", lambda p: p < m["pos"] + F.col("shift")))).alias("skipped")))
        found = found.withColumn("marks", marks).withColumn("start", F.col("first") + F.col("shift"))
        return stage(found.join(self.files.select("path"), "path").drop("first"), "blocks")

    @cached_property
    def _sections(self) -> DataFrame:
        """``path, block, sections``: per block the sections its lines belong to, in order: the line of the mark, the
        line that ends it (NULL: the end of the file), the blank lines before, the header and the frame.

        The first one may have begun in an earlier block. Frames are counted per block, so no task sees the marks of
        a whole file.
        """
        blocks = self._blocks.select("path", "block", "marks")
        order = Window.partitionBy("path").orderBy("block")
        earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        atoms = F.aggregate("marks", F.lit(0).cast("long"), lambda total, m: total + m["atoms"])
        edge = blocks.select(
            "path", "block", F.coalesce(F.sum(atoms).over(earlier), F.lit(0)).alias("frames"),
            F.last(F.try_element_at("marks", F.lit(-1)), ignorenulls=True).over(earlier).alias("open"),
            F.first(F.get("marks", F.lit(0))["line"], ignorenulls=True).over(later).alias("next"))
        inside = Window.partitionBy("path", "block").orderBy("line")
        own = blocks.select("path", "block", F.explode("marks").alias("m")).select("path", "block", "m.*")
        own = own.withColumns({
            "end": F.lead("line").over(inside),
            "frame": F.coalesce(F.sum("atoms").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        own = own.groupBy("path", "block").agg(
            F.sort_array(F.collect_list(F.struct("line", "end", "skipped", "header", "frame"))).alias("own"))
        joined = stage(edge, "edges").join(own, ["path", "block"], "left")
        empty = F.array().cast("array<struct<line:bigint,end:bigint,skipped:bigint,header:string,frame:bigint>>")

        def section(s: Column, end: Column, frame: Column) -> Column:
            return F.struct(s["line"].alias("line"), end.alias("end"), s["skipped"].cast("long").alias("skipped"),
                            s["header"].alias("header"), frame.alias("frame"))

        first = F.coalesce(F.get("own", F.lit(0))["line"], F.col("next"))
        opened = F.when(F.col("open").isNotNull(), F.array(section(
            F.col("open"), first, F.col("frames") - F.col("open.atoms")))).otherwise(empty)
        mine = F.transform(F.coalesce("own", empty), lambda s: section(
            s, F.coalesce(s["end"], F.col("next")), s["frame"] + F.col("frames")))
        sections = F.concat(opened, mine)
        if self.first_frame:
            sections = F.filter(sections, lambda s: s["frame"] == 0)
        return stage(joined.select("path", "block", sections.alias("sections")), "sections")

    def _snapshot(self) -> Column:
        """Name of a snapshot from ``file`` and ``frame``."""
        return F.col("file") if self.first_frame else F.concat_ws("#", "file", F.col("frame").cast("string"))

    def _named(self, rows: DataFrame) -> DataFrame:
        """``path, frame`` replaced by the name of the snapshot."""
        return rows.join(self.files, "path").withColumn("file", self._snapshot()).drop("path", "frame")

    @cached_property
    def _snapshots(self) -> DataFrame:
        """``file`` of every frame; a file without marks has one."""
        frames = self._sections.select("path", F.explode("sections").alias("s")).select("path", "s.frame").distinct()
        every = self.files.select("path").join(frames, "path", "left").withColumn("frame", F.coalesce("frame", F.lit(0)))
        return stage(self._named(every), "snapshots")

    def _placed(self) -> DataFrame:
        """Rows of all wanted sections: ``file, header, row`` (0-based in the section) and the line.

        ``starts`` holds, for each chunk of lines of a block, how many sections begin before it; a line looks only
        at the sections around its own chunk.
        """
        base = F.shiftright("start", CHUNK)
        chunks = F.sequence(base, F.shiftright(F.col("start") + F.col("n"), CHUNK) + 1)
        starts = F.transform(chunks, lambda c: F.size(F.filter("sections", lambda s: s["line"] < F.shiftleft(c, CHUNK))))
        blocks = self._blocks.select("source", "path", "block", "shift", "start", "n", "blanks", "before").join(
            self._sections, ["path", "block"]).join(self.files, "path")
        blocks = blocks.withColumns({
            "starts": starts, "base": base, "sections": F.transform("sections", self._read_as)}).drop("path", "start", "n")
        lines = self._lines().join(stage(blocks, "placed"), ["source", "block"]).withColumn("line", F.col("pos") + F.col("shift"))
        line = F.col("line")
        chunk = (F.shiftright("line", CHUNK) - F.col("base")).cast("int")
        low, high = F.get("starts", chunk), F.get("starts", chunk + 1)
        near = F.slice("sections", F.greatest(low, F.lit(1)), high - low + 1)
        here = F.filter(near, lambda s: (s["line"] < line) & (s["end"].isNull() | (line < s["end"])))
        lines = lines.withColumn("section", F.get(here, F.lit(0))).filter(
            F.col("section").isNotNull() & (F.length(_stripped(F.col("value"))) > 0))
        blanks = F.col("before") + F.size(F.filter("blanks", lambda b: b < line)) - F.col("section.skipped")
        return lines.withColumn("frame", F.col("section.frame")).select(
            self._snapshot().alias("file"), F.col("section.header").alias("header"), F.col("section.read").alias("read"),
            (line - F.col("section.line") - 1 - blanks).alias("row"), "value")

    def _read_as(self, section: Column) -> Column:
        """A section with ``read``, which its atom rows share: the 1-based positions of ``x, y, z``, of the other columns
        and of the boxed reader's coordinates, NULL where there is none."""
        columns = _columns(section["header"])
        names = self._names(columns)
        at = _coordinate_positions(columns)
        read = F.struct(
            *[_at(a, columns).alias(a) for a in "xyz"],
            F.transform(names, lambda c: F.array_position(columns, c)).alias("numbers"),
            *[at[a].cast("long").alias(f"b{a}") for a in "xyz"])
        return section.withField("read", F.when(section["header"].startswith(ATOMS_MARK), read))

    @cached_property
    def _rows(self) -> DataFrame:
        """Every row parsed once for both readers and written: numbers for atoms, the line for other sections.

        ``x, y, z, numbers`` and ``bad`` (a missing or non-numeric value) are the generic reader's; ``bx, by, bz``,
        ``short`` (fewer columns than wanted) and ``bad_box`` the boxed reader's.
        """
        atoms = F.col("header").startswith(ATOMS_MARK)
        rows = self._placed().withColumns({"atoms": atoms, "parts": F.when(atoms, _tokens(F.col("value")))})
        read = F.col("read")
        rows = rows.withColumns({
            **{a: _number(F.col("parts"), read[a]) for a in [*"xyz", "bx", "by", "bz"]},
            "numbers": F.transform(read["numbers"], lambda p: _number(F.col("parts"), p)),
            "short": F.size("parts") < F.greatest(*[read[f"b{a}"] for a in "xyz"]),
        })
        bad, bad_box = F.exists("numbers", lambda v: v.isNull()), F.lit(False)
        for a in "xyz":
            bad, bad_box = bad | F.col(a).isNull(), bad_box | F.col(f"b{a}").isNull()
        rows = rows.withColumns({"bad": bad, "bad_box": ~F.col("short") & bad_box})
        return stage(rows.withColumn("value", F.when(~F.col("atoms"), F.col("value"))).drop("parts", "read"), "rows")

    def _names(self, columns: Column) -> Column:
        named = F.array_distinct(F.filter(columns, lambda c: ~c.isin("x", "y", "z")))
        return F.slice(named, 1, self.max_extra)

    @cached_property
    def _heads(self) -> DataFrame:
        """``file, header`` of the atoms section."""
        marks = self._sections.select("path", F.explode("sections").alias("s")).select("path", "s.frame", "s.header")
        return self._named(marks.filter(F.col("header").startswith(ATOMS_MARK)).distinct()).select("file", "header")

    def _small(self, mark: str) -> DataFrame:
        return self._rows.filter(~F.col("atoms") & F.col("header").startswith(mark)).select("file", "header", "row", "value")

    @cached_property
    def status(self) -> DataFrame:
        """One row per snapshot: ``ok`` or why it was set aside."""
        heads = self._heads.withColumn("columns", _columns(F.col("header"))).withColumn(
            "complete", F.forall(F.array(*map(F.lit, "xyz")), lambda a: F.array_contains("columns", a))).drop("header")
        rows = self._rows.filter("atoms").groupBy("file").agg(
            F.count("*").alias("num_atoms"), F.max("bad").alias("any_bad"))
        joined = self._snapshots.join(heads, "file", "left").join(rows, "file", "left")
        status = (
            F.when(F.col("complete").isNull(), NO_ATOMS)
            .when(~F.col("complete"), NO_COORDINATES)
            .when(F.coalesce("any_bad", F.lit(False)), BAD_VALUE)
            .otherwise(OK)
        )
        return stage(joined.select(
            "file", status.alias("status"), "columns",
            F.coalesce("num_atoms", F.lit(0)).cast("long").alias("num_atoms")), "status")

    def snapshots(self) -> DataFrame:
        """``snapshot_id, columns, num_atoms`` of the good files."""
        return self.status.filter(F.col("status") == OK).select(
            F.col("file").alias("snapshot_id"), "columns", "num_atoms")

    def quarantine(self) -> DataFrame:
        """Files set aside, with the reason."""
        return self.status.filter(F.col("status") != OK).select("file", "status")

    def atoms(self) -> DataFrame:
        """``snapshot_id, atom_id, x, y, z, extra`` of the good files."""
        good = self._rows.filter("atoms").join(self.quarantine().select("file"), "file", "left_anti")
        return good.withColumn("columns", _columns(F.col("header"))).select(
            F.col("file").alias("snapshot_id"), F.col("row").alias("atom_id"), "x", "y", "z",
            F.map_from_arrays(self._names(F.col("columns")), "numbers").alias("extra"))

    def _tilted(self) -> DataFrame:
        """Snapshots whose bounds are those of a tilted box."""
        words = _tokens(F.col("header"))
        tilted = F.lit(True)
        for w in TILT_WORDS:
            tilted = tilted & F.array_contains(words, w)
        return self._small(BOUNDS_MARK).filter(tilted).select("file").distinct()

    def cells(self) -> DataFrame:
        """Cell bounds and tilts ``xy, xz, yz`` (0 in a straight box), atom count and boundary flags of the snapshots with
        three bounds. Tilted bounds are written around the whole cell; the overhang is taken off here."""
        tilt = self._bounds(self._small(BOUNDS_MARK), third=True)
        tilted = self._tilted().withColumnRenamed("file", "snapshot_id").withColumn("_tilted", F.lit(True))
        zero = F.lit(0.0)
        t = {n: F.when(F.col("_tilted").isNotNull(), F.coalesce(n, zero)).otherwise(zero) for n in TILT_WORDS}
        cells = tilt.join(tilted, "snapshot_id", "left").withColumns(t).drop("_tilted")
        x_ends = [zero, F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")]
        return cells.withColumns({
            "xlo": F.col("xlo") - F.least(*x_ends), "xhi": F.col("xhi") - F.greatest(*x_ends),
            "ylo": F.col("ylo") - F.least(zero, F.col("yz")), "yhi": F.col("yhi") - F.greatest(zero, F.col("yz"))})

    def boxes(self) -> DataFrame:
        """Orthogonal bounds, atom count and boundary flags of the snapshots with three of them; ``boxed_status`` names
        the others. A tilted box has no orthogonal bounds."""
        return self._bounds(self._small(BOUNDS_MARK).join(self._tilted(), "file", "left_anti"))

    def _bounds(self, lines: DataFrame, third: bool = False) -> DataFrame:
        """One row per snapshot from its three lines of bounds; the third number of each is a tilt."""
        bounds = lines.filter("row < 3").withColumn("parts", _tokens(F.col("value")))

        def number(row: int, position: int) -> Column:
            return F.max(F.when(F.col("row") == row, _number(F.col("parts"), F.lit(position))))

        values = {f"{axis}{end}": number(row, position) for row, axis in enumerate("xyz")
                  for position, end in ((1, "lo"), (2, "hi"))}
        tilts = {name: number(row, 3) for row, name in enumerate(TILT_WORDS)} if third else {}
        flags = F.slice(_tokens(F.col("header")), -3, 3)
        per_file = bounds.groupBy("file").agg(
            *[c.alias(n) for n, c in {**values, **tilts}.items()], F.first(flags).alias("boundary"))
        counts = self._small(COUNT_MARK).filter("row = 0").select(
            "file", _stripped(F.col("value")).try_cast("long").alias("declared_atoms"))
        complete = " and ".join(f"{n} is not null" for n in values)
        return per_file.filter(complete).join(counts, "file", "left").withColumnRenamed("file", "snapshot_id")

    def _boxed_rows(self) -> DataFrame:
        """Atom rows up to the declared count that are long enough, with the columns of their box."""
        heads = self._heads.select(F.col("file").alias("snapshot_id"), _scaled().alias("scaled"))
        boxes = self.boxes().drop("boundary").join(heads, "snapshot_id")
        rows = self._rows.filter("atoms").select(
            F.col("file").alias("snapshot_id"), F.col("row").alias("atom_id"), "bx", "by", "bz", "short", "bad_box")
        rows = attach(rows, stage(with_last_chunk(rows, boxes), "boxes"))
        return rows.filter(~F.col("short") & (F.col("declared_atoms").isNull() | (F.col("atom_id") < F.col("declared_atoms"))))

    @cached_property
    def boxed_status(self) -> DataFrame:
        """``file, status, num_atoms`` for the boxed reader, one row per snapshot.

        Those without an atoms section, with a tilted box, without three bounds, without coordinate columns or with a non-numeric
        coordinate are set aside. ``fewer rows than declared`` is a note: short lines are left out, the rest of
        such a file is used.
        """
        at = _coordinate_positions(F.col("columns"))
        heads = self._heads.withColumn("columns", _columns(F.col("header"))).select(
            "file", F.greatest(*at.values()).alias("last"),
            F.forall(F.array(*at.values()), lambda p: p.isNotNull()).alias("complete"))
        boxes = self.boxes().select(F.col("snapshot_id").alias("file"), "declared_atoms", F.lit(True).alias("boxed"))
        rows = self._boxed_rows().groupBy(F.col("snapshot_id").alias("file")).agg(
            F.count("*").alias("n"), F.max("bad_box").alias("any_bad"))
        tilted = self._tilted().select("file", F.lit(True).alias("tilted"))
        joined = self._snapshots.join(heads, "file", "left").join(boxes, "file", "left").join(rows, "file", "left").join(
            tilted, "file", "left")
        n = F.coalesce("n", F.lit(0)).cast("long")
        status = (
            F.when(F.col("complete").isNull(), NO_ATOMS)
            .when(F.col("tilted").isNotNull(), TILTED)
            .when(F.col("boxed").isNull(), NO_BOUNDS)
            .when(~F.col("complete"), NO_COORDINATES)
            .when(F.coalesce("any_bad", F.lit(False)), BAD_VALUE)
            .when(n < F.col("declared_atoms"), FEWER_ROWS)
            .otherwise(OK)
        )
        return stage(joined.select("file", status.alias("status"), n.alias("num_atoms")), "boxed-status")

    def boxed_atoms(self) -> DataFrame:
        """Positions for the lattice comparison: x, xu or xs columns, else the third to fifth.

        Rows beyond the declared count and rows too short are left out, files that ``boxed_status`` sets aside
        stay away whole; scaled coordinates are unscaled.
        """
        aside = self.boxed_status.filter(~F.col("status").isin(OK, FEWER_ROWS)).select(F.col("file").alias("snapshot_id"))
        rows = self._boxed_rows().join(aside, "snapshot_id", "left_anti")
        out = {}
        for axis in "xyz":
            value, low, high = F.col(f"b{axis}"), F.col(f"{axis}lo"), F.col(f"{axis}hi")
            out[axis] = F.when(F.col("scaled"), value * (high - low) + low).otherwise(value)
        return rows.withColumns(out).select("snapshot_id", "atom_id", "x", "y", "z")


def _columns(header: Column) -> Column:
    """Column names of an atoms header."""
    return F.slice(_tokens(header), 3, 1 << 20)


def _at(name: str, columns: Column) -> Column:
    return F.nullif(F.array_position(columns, F.lit(name)), F.lit(0))


def _coordinate_positions(columns: Column) -> dict[str, Column]:
    """1-based columns of the boxed reader; NULL where an axis is missing."""
    unnamed = F.coalesce(*[_at(a, columns) for a in ("x", "xu", "xs")]).isNull()
    return {a: F.when(unnamed, F.lit(position + 1)).otherwise(F.coalesce(*[_at(f"{a}{kind}", columns) for kind in ("", "u", "s")]))
            for a, position in FALLBACK_COLUMNS.items()}


def _scaled() -> Column:
    """Whether the header gives box fractions only."""
    columns = _columns(F.col("header"))
    return F.array_contains(columns, "xs") & ~F.array_contains(columns, "x") & ~F.array_contains(columns, "xu")


def scan_dumps(
    spark: SparkSession, path: str, max_extra: int = MAX_EXTRA, name_pattern: str | None = None, first_frame: bool = True
) -> DumpScan:
    return DumpScan(spark, path, max_extra, name_pattern, first_frame)


def run_summary(status: DataFrame) -> DataFrame:
    """Files per status."""
    return status.groupBy("status").agg(F.count("*").alias("files")).orderBy("status")


def failed_files(status: DataFrame, n: int = FAILED_NAMES) -> DataFrame:
    """The first ``n`` failed names."""
    return status.filter(F.col("status") != OK).select("file", "status").orderBy("file").limit(n)
