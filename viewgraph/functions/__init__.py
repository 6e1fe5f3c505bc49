"""Part of viewgraph."""
