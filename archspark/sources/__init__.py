"""Where rows come from and go to: source trees, configuration files, exports."""
