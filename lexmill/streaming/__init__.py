"""Changes as streams: debounced rescans, and the registry of open documents."""
