"""Plans: query language, index maintenance, the engine that ties operators together."""
