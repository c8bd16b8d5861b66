"""Operators for preparing training data: deduplication, decontamination, scoring, mixing, privacy and licences.

Nothing else in the library imports this subpackage. The queries over the standard tables are in :mod:`.queries`.
"""
