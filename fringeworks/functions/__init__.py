"""Column expressions: word decoding, phase, units, time."""
