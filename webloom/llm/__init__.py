"""Training-data operators: language ID, decontamination, pseudonyms, near
and substring duplicates, toxicity, secret scans, tokenisation, fingerprints."""
