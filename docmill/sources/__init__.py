"""Sources, sinks and user functions around the engine."""
