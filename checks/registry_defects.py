"""Registered box, neighbor and Wigner-Seitz queries."""

from __future__ import annotations

from checks.fixtures import (
    boxes_customer,
    boxes_solvent,
    boxes_supplier,
    boxes_tilted,
    cloud_embeddings,
    cloud_lineitem,
    cloud_orders,
    cube_box,
    reference_box,
    sites_cube,
    sites_lattice,
)
from checks.registry_features import rounded
from voidscope.operators import images, neighbors, surface
from voidscope.operators import wigner_seitz as ws

PAIR_RADIUS = 4.0
PROBE_RADIUS = 6.0
NEAR_SURFACE = 4.0
IMAGE_RADIUS = 2.5
SLAB_RADIUS = 2.5
NEAR_SLAB = 1.0


def analysis(spark, sf_dir, affine: bool = False) -> ws.WignerSeitz:
    return ws.WignerSeitz(
        cloud_lineitem(spark, sf_dir), sites_lattice(spark), boxes_supplier(spark, sf_dir), reference_box(),
        periodic=True, affine=affine)


def _nearest(affine: bool):
    def run(spark, sf_dir):
        return rounded(neighbors.nearest_site(
            cloud_lineitem(spark, sf_dir), sites_lattice(spark), boxes_supplier(spark, sf_dir),
            reference_box(), periodic=True, affine=affine))

    return run


QUERIES = {
    "pbc_wrap": lambda s, d: rounded(ws.pbc_wrap(cloud_lineitem(s, d), boxes_supplier(s, d))),
    "affine_map": lambda s, d: rounded(
        ws.affine_map(sites_lattice(s), boxes_supplier(s, d), reference_box(), 1000)),
    "strain": lambda s, d: rounded(ws.strain(boxes_supplier(s, d), reference_box()), volume=4),
    "nearest_site_pbc": _nearest(affine=False),
    "nearest_site_affine": _nearest(affine=True),
    "nearest_site_open": lambda s, d: rounded(
        neighbors.nearest_site(cloud_lineitem(s, d), sites_lattice(s), periodic=False)),
    "radius_pairs": lambda s, d: rounded(neighbors.radius_pairs(cloud_lineitem(s, d), PAIR_RADIUS)),
    "radius_pairs_pbc": lambda s, d: rounded(
        neighbors.radius_pairs(cloud_lineitem(s, d), PAIR_RADIUS, boxes_supplier(s, d))),
    "radius_pairs_embedded": lambda s, d: rounded(neighbors.radius_pairs(cloud_embeddings(s, d), 0.1)),
    "surface_atoms": lambda s, d: surface.surface_atoms(cloud_lineitem(s, d), PROBE_RADIUS),
    "surface_distance": lambda s, d: rounded(
        surface.within_surface(cloud_lineitem(s, d), NEAR_SURFACE, PROBE_RADIUS)),
    "radius_pairs_images": lambda s, d: rounded(
        images.radius_pairs_images(cloud_orders(s, d), IMAGE_RADIUS, boxes_customer(s, d))),
    "radius_pairs_tilted": lambda s, d: rounded(
        images.radius_pairs_images(cloud_orders(s, d), IMAGE_RADIUS, boxes_tilted(s, d))),
    "surface_atoms_slab": lambda s, d: surface.surface_atoms(cloud_orders(s, d), SLAB_RADIUS, boxes_customer(s, d)),
    "surface_distance_slab": lambda s, d: rounded(
        surface.within_surface(cloud_orders(s, d), NEAR_SLAB, SLAB_RADIUS, boxes_customer(s, d))),
    "ws_summary_complete": lambda s, d: rounded(ws.WignerSeitz(
        cloud_orders(s, d), sites_cube(s), boxes_solvent(s, d), cube_box(), affine=True).reported()),
    "ws_occupancy": lambda s, d: analysis(s, d).occupancy(),
    "ws_vacancies": lambda s, d: rounded(analysis(s, d).vacancies()),
    "ws_vacancies_affine": lambda s, d: rounded(analysis(s, d, affine=True).vacancies()),
    "ws_interstitials": lambda s, d: rounded(analysis(s, d).interstitials()),
    "ws_summary": lambda s, d: rounded(analysis(s, d).summary()),
    "ws_summary_affine": lambda s, d: rounded(analysis(s, d, affine=True).summary()),
}
