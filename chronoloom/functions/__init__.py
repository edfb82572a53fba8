"""Part of the package; see the modules."""
