"""Training-data operators: quality, near-duplicates, decontamination, packing, archives.

Nothing outside this subpackage imports it; its queries are added by the entry module.
"""
