"""Training-data operators: language id, quality, fingerprints, mixing, URL filter, token files,
decontamination, near-duplicate join, web archive and personal data.  Nothing else in the library imports this."""
