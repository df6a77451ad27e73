"""Units of the telemetry reports: sizes are binary, link rates decimal."""

KIB, MIB, GIB = 1024, 1024**2, 1024**3
GBIT_BYTES = 1e9 / 8
U64 = 18446744073709551616
