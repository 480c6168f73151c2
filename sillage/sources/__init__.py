"""Where rows come from: files, archives, JSON texts, manifests and bound tables."""
