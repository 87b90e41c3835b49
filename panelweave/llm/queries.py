"""All registered queries of this subpackage and their SQL."""

from panelweave.llm import chat, decontaminate, langid, lengths, licences, mixing, negatives, partitions, quality, resampling, secrets, simhash, warc  # noqa: F401
from panelweave.llm.common import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
