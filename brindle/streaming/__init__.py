"""The same jobs over request streams."""
