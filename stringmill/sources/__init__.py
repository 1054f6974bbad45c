"""Readers, writers, the FASTA data source and seeded generators."""

from . import datagen, fasta, folders, readers, writers

__all__ = ["datagen", "fasta", "folders", "readers", "writers"]
