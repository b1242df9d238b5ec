"""Site occupancy, vacancies, interstitials and strain against a reference lattice.

``site_id`` is the 0-based row position in the reference, as ``atom_id`` is in a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.functions.geometry import volume
from voidscope.operators.neighbors import AXES, POINT, nearest_site, wrap_points, wrap_sites
from voidscope.session import stage

OK, NO_BOX, NO_ATOMS = "ok", "no box", "no atoms"
SITE_BLOCK_BITS = 12  # vacancies are found per block of 4096 consecutive sites


def pbc_wrap(points: DataFrame, boxes: DataFrame) -> DataFrame:
    return wrap_points(points, boxes).select(*POINT, *AXES)


def strain(boxes: DataFrame, ref_box: dict[str, float]) -> DataFrame:
    """Volume and volumetric strain of every box against the reference box."""
    reference = 1.0
    for a in AXES:
        reference *= ref_box[f"{a}hi"] - ref_box[f"{a}lo"]
    return volume(boxes).select(
        "snapshot_id", "volume", ((F.col("volume") - reference) / reference).alias("volumetric_strain"))


def _factor(a: str, ref_box: dict[str, float]) -> Column:
    return (F.col(f"{a}hi") - F.col(f"{a}lo")) / (ref_box[f"{a}hi"] - ref_box[f"{a}lo"])


def place_sites(
    listed: DataFrame,
    sites: DataFrame,
    boxes: DataFrame | None,
    ref_box: dict[str, float] | None,
    periodic: bool,
    affine: bool,
) -> DataFrame:
    """Positions of (snapshot_id, site_id) rows: wrapped in the reference box, scaled to the snapshot's."""
    placed = wrap_sites(sites, ref_box) if periodic else sites
    joined = listed.join(placed, ["snapshot_id", "site_id"] if "snapshot_id" in sites.columns else "site_id")
    if not affine:
        return joined
    factors = boxes.select("snapshot_id", *[_factor(a, ref_box).alias(f"_s{a}") for a in AXES])
    return joined.join(factors, "snapshot_id").withColumns(
        {a: F.col(a) * F.col(f"_s{a}") for a in AXES}).drop(*[f"_s{a}" for a in AXES])


def every_site(snapshots: DataFrame, count: int) -> DataFrame:
    """All ``site_id`` 0..count-1 for every snapshot, listed block by block: no array, in the plan or in a row,
    holds more than one block of ids."""
    size = 1 << SITE_BLOCK_BITS
    blocks = snapshots.select("snapshot_id", F.explode(F.array(F.lit(count))).alias("_n")).withColumn(
        "_high", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_n").cast("long") - 1, 2 * SITE_BLOCK_BITS))))
    last = F.shiftright(F.col("_n").cast("long") - 1, SITE_BLOCK_BITS)
    blocks = blocks.withColumn("_block", F.explode(F.sequence(
        F.col("_high") * size, F.least(F.col("_high") * size + size - 1, last))))
    start = F.col("_block") * size
    return blocks.select("snapshot_id", F.explode(F.sequence(
        start, F.least(start + size - 1, F.col("_n").cast("long") - 1))).alias("site_id"))


def affine_map(sites: DataFrame, boxes: DataFrame, ref_box: dict[str, float], count: int) -> DataFrame:
    """Every reference site (``site_id`` 0..count-1) wrapped and scaled into every snapshot's box."""
    listed = every_site(boxes.select("snapshot_id"), count)
    return place_sites(listed, sites, boxes, ref_box, periodic=True, affine=True).select(
        "snapshot_id", "site_id", *AXES)


class WignerSeitz:
    """Occupancy analysis of many snapshots against one shared reference.

    The assignment is computed and staged once; every table below derives from it by aggregation and
    equi-joins, so neither a crowded site nor a huge snapshot is gathered in one task.
    """

    def __init__(
        self,
        points: DataFrame,
        sites: DataFrame,
        boxes: DataFrame | None = None,
        ref_box: dict[str, float] | None = None,
        periodic: bool = True,
        affine: bool = False,
    ):
        if "snapshot_id" in sites.columns:
            raise ValueError("the reference is one set of sites for all snapshots")
        self.points, self.sites, self.boxes, self.ref_box = points, sites, boxes, ref_box
        self.periodic, self.affine = periodic, affine
        self.n_sites = sites.count()
        self.assignment = stage(
            nearest_site(points, sites, boxes, ref_box, periodic, affine), "assignment")
        self._occupied = self.assignment.groupBy("snapshot_id", "site_id").agg(
            F.count("*").alias("occupancy"), F.min("atom_id").alias("first_atom"))

    def _snapshots(self) -> DataFrame:
        return self.assignment.select("snapshot_id").distinct()

    def occupancy(self) -> DataFrame:
        """Atoms per site, zeros kept."""
        every = every_site(self._snapshots(), self.n_sites)
        counted = self._occupied.drop("first_atom")
        return every.join(counted, ["snapshot_id", "site_id"], "left").select(
            "snapshot_id", "site_id", F.coalesce("occupancy", F.lit(0)).cast("long").alias("occupancy"))

    def vacant_sites(self) -> DataFrame:
        """(snapshot_id, site_id) of sites without atoms.

        Occupied ids are collected per block of 4096 sites and subtracted from the block, so only vacant
        sites become rows.
        """
        size, last = 1 << SITE_BLOCK_BITS, self.n_sites - 1
        blocks = self._snapshots().withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last >> SITE_BLOCK_BITS).cast("long"))))
        filled = self._occupied.groupBy(
            "snapshot_id", F.shiftright("site_id", SITE_BLOCK_BITS).alias("block")
        ).agg(F.collect_list("site_id").alias("_filled"))
        whole = F.sequence(F.col("block") * size, F.least(F.col("block") * size + size - 1, F.lit(last)))
        return blocks.join(filled, ["snapshot_id", "block"], "left").select(
            "snapshot_id",
            F.explode(F.array_except(
                whole, F.coalesce("_filled", F.array().cast("array<long>")))).alias("site_id"))

    def vacancies(self) -> DataFrame:
        """Vacant sites with their positions."""
        return place_sites(
            self.vacant_sites(), self.sites, self.boxes, self.ref_box, self.periodic, self.affine
        ).select("snapshot_id", "site_id", *AXES)

    def interstitials(self) -> DataFrame:
        """Atoms beyond the lowest-numbered one of their site, with their (wrapped) positions."""
        rightful = self._occupied.select("snapshot_id", F.col("first_atom").alias("atom_id"))
        # usually few, and staged so that the join below can see that
        extra = stage(self.assignment.join(rightful, POINT, "left_anti").select(*POINT, "site_id"), "extra")
        placed = pbc_wrap(self.points, self.boxes) if self.periodic else self.points.select(*POINT, *AXES)
        return extra.join(placed, POINT).select(*POINT, "site_id", *AXES)

    def status(self) -> DataFrame:
        """``snapshot_id, status`` of every snapshot that has points or a box: ``ok``, ``no box`` where the matching
        needs one, or ``no atoms``."""
        filled = self.points.select("snapshot_id").distinct().withColumn("_filled", F.lit(True))
        if self.boxes is None:
            return filled.select("snapshot_id", F.lit(OK).alias("status"))
        sized = self.boxes.select("snapshot_id").distinct().withColumn("_sized", F.lit(True))
        status = F.when(F.lit(self.periodic or self.affine) & F.col("_sized").isNull(), NO_BOX).when(
            F.col("_filled").isNull(), NO_ATOMS).otherwise(OK)
        return filled.join(sized, "snapshot_id", "full").select("snapshot_id", status.alias("status"))

    def reported(self) -> DataFrame:
        """:meth:`summary` with the ``status`` of each snapshot."""
        n_ref = F.lit(self.n_sites).cast("long")
        totals = self._occupied.groupBy("snapshot_id").agg(
            F.count("*").alias("_occupied"), F.sum("occupancy").alias("_atoms"))
        rows = self.status().join(totals, "snapshot_id", "left")
        known = F.col("status") != NO_BOX
        occupied, atoms = (F.when(known, F.coalesce(c, F.lit(0)).cast("long")) for c in ("_occupied", "_atoms"))
        rows = rows.select(
            "snapshot_id", "status", (n_ref - occupied).alias("n_vacancies"),
            (atoms - occupied).alias("n_interstitials"), n_ref.alias("n_reference_sites"),
            atoms.alias("n_defective_atoms"))
        for count, share in (("n_vacancies", "vacancy_concentration"), ("n_interstitials", "interstitial_concentration")):
            rows = rows.withColumn(share, F.when(n_ref > 0, F.col(count) / n_ref).when(known, 0.0))
        if self.boxes is None:
            return rows.withColumn("volumetric_strain", F.lit(None).cast("double"))
        return rows.join(strain(self.boxes, self.ref_box).drop("volume"), "snapshot_id", "left")

    def summary(self) -> DataFrame:
        """Counts, concentrations and strain, one row per snapshot that has points or a box.

        Without any atom all sites are vacant; where the matching needs a box that is missing, counts are NULL.
        """
        return self.reported().drop("status")
