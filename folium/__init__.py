"""folium: document collections as Spark DataFrames."""
