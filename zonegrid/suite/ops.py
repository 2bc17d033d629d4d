"""Operations queries: file checksum manifest and output inventory (rows-only)."""

from __future__ import annotations

import hashlib

from ..plans.retrieval import OUTPUTS, run_retrieval
from ..session import shared_path
from ..sources import files
from ..sources.sinks import run_path
from .base import P, register, trips


@register("file_manifest")
def q_file_manifest(spark, sf_dir):
    """Checksums of the data folder's files vs the stored manifest (read-only)."""
    key = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    manifest = files.read_manifest(spark, shared_path(spark, "manifests", key))
    return files.manifest_status(files.file_checksums(spark, sf_dir), manifest)


@register("output_inventory")
def q_output_inventory(spark, sf_dir):
    """Run the retrieval job into a fresh folder, then inventory its outputs."""
    out = run_path(spark, "retrieval")
    run_retrieval(spark, trips(spark, sf_dir), P, out)
    return files.output_inventory(spark, out, OUTPUTS)
