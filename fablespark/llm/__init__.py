"""Training-data operators: near duplicates, archives, decontamination, packing and their kin.

Nothing outside this subpackage imports it.
"""
