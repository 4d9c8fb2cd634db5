"""Document-metadata engine on Spark: text normalisation, extraction, voting, register lookups, review and filing plans."""

__version__ = "0.1.0"
