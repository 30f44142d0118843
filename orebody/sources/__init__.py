"""Sources and sinks: source trees, ignore rules, module maps, stored state."""
