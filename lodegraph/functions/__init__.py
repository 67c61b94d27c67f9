"""Part of lodegraph."""
