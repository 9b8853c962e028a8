"""Corpus pipeline: documents in, packed training sequences out.

The stages are in plumbline/llm/stages.py. There are five, each written as Parquet and read again before the next: language
ID drops documents in no known language (a null text or one without a letter;
where no row that trains has a language, all others stay), exact dedup keeps one row of equal
texts, the n-gram Jaccard join keeps one document of each group of near
copies, decontamination drops documents that a benchmark's passages cover by a
twentieth or more, and best-fit packing places the rest in sequences.

Every stage but the last returns the columns it was given, whatever they are
called. The near-duplicate stage judges rows, not ids: of a group one row stays,
that with the smallest id, and a null id ranks last. An empty table gives an
empty result.
"""

from __future__ import annotations

from plumbline.llm.stages import STAGES, clean, exact, language, near, pack, run

__all__ = ["ORACLE_SQL", "STAGES", "clean", "exact", "language", "near", "pack", "run"]

#: Language ID, the near-duplicate groups, token ids and the packing plan are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
