"""Where rows come from: folders of files, tables that stand for files, the model catalogue."""
