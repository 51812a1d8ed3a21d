"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, bpe, chat, decontam, embeddings, langid, licenses, minhash, phrases, quality, substring, tokenbin, warc

MODULES = (embeddings, licenses, langid, bpe, quality, minhash, substring, decontam, warc, tokenbin, align, chat, phrases)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
