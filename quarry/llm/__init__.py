"""Training-data pipeline operators (token counts, joins, decontamination, ...).

Nothing else in the library imports this subpackage.
"""
