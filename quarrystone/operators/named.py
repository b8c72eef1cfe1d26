"""Sources and operators by the names that configs use; importing this fills the registries."""

from __future__ import annotations

from quarrystone.functions.registry import OPERATORS, SOURCES
from quarrystone.operators import curate, datasets, degradation, niqe, samples, scoring
from quarrystone.sources import events, files, keyvalue

for _name, _source in {
    "csv": files.read_csv,
    "parquet": files.read_parquet,
    "files": files.list_files,
    "archives": files.list_archives,
    "images": files.read_images,
    "events": events.read_events,
    "key_values": keyvalue.read_store,
}.items():
    SOURCES.register(_source, _name)

for _name, _operator in {
    "filter_manifest": curate.filter_manifest,
    "match_manifest": curate.match_manifest,
    "latent_pairs": datasets.latent_pairs,
    "image_pairs": datasets.image_pairs,
    "frame_samples": datasets.frame_samples,
    "single_images": samples.single_images,
    "face_images": samples.face_images,
    "paired_patches": samples.paired_patches,
    "degradation_samples": samples.degradation_samples,
    "paired_latents": samples.paired_latents,
    "septuplet_tests": samples.septuplet_tests,
    "degraded": degradation.degraded,
    "block_rows": niqe.block_rows,
    "predicted": scoring.predicted,
}.items():
    OPERATORS.register(_operator, _name)
