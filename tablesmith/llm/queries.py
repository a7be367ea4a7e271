"""Queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

from . import chat, decontamination, divergence, languages, licences, line_crf, ngram_join, packing, phrases, pii, quality_rules, secrets, warc

QUERIES = {**quality_rules.QUERIES, **warc.QUERIES, **decontamination.QUERIES, **secrets.QUERIES, **pii.QUERIES, **chat.QUERIES, **licences.QUERIES, **line_crf.QUERIES, **packing.QUERIES, **ngram_join.QUERIES, **divergence.QUERIES, **languages.QUERIES, **phrases.QUERIES}
