"""Windows and state over event streams; the window functions take batch tables too."""
