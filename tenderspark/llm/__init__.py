"""Training-data operators: media columns, language ID, license scans, near-dedup, secret scans,
HTML extraction, WARC archives, SentencePiece, benchmark decontamination, token-id output, personal data, filter audits
and fill-in-middle.

Nothing else in the library imports this subpackage.
"""
