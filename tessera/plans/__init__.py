"""Part of the engine; see the modules."""
