"""claimlake: evidence-backed claims from mail and document corpora, on Spark."""
