"""Where rows come from: system tables, source corpora, logs."""
