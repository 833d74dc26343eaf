"""Program analysis and compilation of rule bodies to DataFrame plans."""
